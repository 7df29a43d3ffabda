"""Operators on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import changes, chunking, fusion, graph, lexical, ranking, resolve, vector
from quarry.plans import output
from quarry.plans.search import search_type
from quarry.sources import files as sources
from quarry.sources.config import Config, Model, ModelRegistry


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("getUserName", "get User Name"), ("XMLParser", "X M L Parser"), ("__init__", "init"), ("snake_case_name", "snake case name"), ("a \t\n b", "a b"), ("", "")])
def test_split_identifiers(spark, raw, want):
    assert one(spark, T.split_identifiers(F.col("t")), t=raw) == want


def test_lines_and_windows(spark):
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\n") == ["a", "b"]
    assert one(spark, T.lines(F.col("t")), t="") == []
    assert one(spark, T.normalize_content(F.col("t")), t="\n\n a  \r\nb\t\r\n\n") == " a\nb"
    assert one(spark, T.head_lines(F.col("t"), 2), t="a\nb\nc") == "a\nb\n..."
    for n, want in ((0, [(1, 0)]), (1, [(1, 1)]), (500, [(1, 500)]), (501, [(1, 500), (451, 501)]), (600, [(1, 500), (451, 600)]), (950, [(1, 500), (451, 950)]), (951, [(1, 500), (451, 950), (901, 951)])):
        df = spark.createDataFrame([(1, "\n".join(f"line{i}" for i in range(n)))], "id int, content string")
        assert [(r["start_line"], r["end_line"]) for r in chunking.line_windows(df).orderBy("start_line").collect()] == want
    with pytest.raises(ValueError):
        chunking.line_windows(df, size=5, overlap=5)


def test_names(spark):
    name = lambda p, s: one(spark, T.display_name(F.col("p"), F.col("s"), F.lit("block"), F.lit(3), F.lit(9)), p=p, s=s)
    assert name("A", "b") == "A.b"
    assert one(spark, T.display_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("block"), F.lit(3), F.lit(9)), x=1) == "block:3-9"
    assert one(spark, T.normalize_token(F.col("t")), t="Get_User-Née2") == "getusernée2"


def test_paths(spark):
    ask = lambda c, p: one(spark, c(F.col("p")), p=p)
    assert [ask(P.language, p) for p in ("a/b.TSX", "x.pyi", "m.hh", "s.vue", "Makefile", ".py", "a.rb")] == ["tsx", "python", "cpp", "html", None, None, None]
    assert [ask(P.normalize, p) for p in ("./a//b/../c", "../../x", "a\\b/./", "")] == ["a/c", "x", "a/b", ""]
    assert ask(lambda c: P.join(P.dirname(c), F.lit("../b/c")), "src/a/x.ts") == "src/b/c"
    assert [ask(P.default_excluded, p) for p in ("a/node_modules/x.js", "x.min.js", "src/x.js", "p.egg-info/y.py", "Cargo.lock", "builds/x.py")] == [True, True, False, True, True, False]
    gone = lambda p, *rules: ask(lambda c: P.ignored(c, list(rules)), p)
    assert gone("a/b.log", "*.log") and not gone("a/b.log", "/*.log") and gone("b.log", "/*.log")
    assert gone("x/docs/a.md", "docs/") and not gone("docs", "docs/") and not gone("a.log", "*.log", "!a.log") and gone("a/x/y/b.c", "a/**/b.c") and gone("f1.c", "f[0-9].c")
    with pytest.raises(P.PatternError):
        P.glob_regex("a[b")


def test_decode(spark):
    rows = [("a.py", bytearray(b"ok"), "python"), ("b.py", bytearray(b"a\0b"), "python"), ("c.py", bytearray(b"\xff\xfeq"), "python"), ("d.rb", bytearray(b"x"), None), ("e.py", bytearray(b"x" * 20), "python")]
    df = spark.createDataFrame(rows, "path string, raw binary, language string")
    got = {r["path"]: r for r in sources.decode(df, max_bytes=10).collect()}
    assert [(got[p]["status"], got[p]["reason"]) for p in ("a.py", "b.py", "c.py", "d.rb", "e.py")] == [("read", None), ("skipped", "binary"), ("read", None), ("skipped", "unsupported_language"), ("skipped", "too_large")]
    assert got["c.py"]["was_lossy"] and got["c.py"]["content"].endswith("q") and "�" in got["c.py"]["content"]
    assert {r["path"]: r["reason"] for r in sources.decode(df, lossy=False).collect()}["c.py"] == "invalid_utf8"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0])], "id long, embedding array<float>")
    index = vector.VectorIndex(v, 3)
    assert [r["id"] for r in index.search([1.0, 0.0, 0.0], 2).collect()] == [1, 3]
    assert [r["id"] for r in index.delete(spark.createDataFrame([(1,)], "id long")).search([1.0, 0.0, 0.0], 10).collect()] == [3, 2]
    with pytest.raises(vector.DimensionError):
        index.search([1.0], 1)
    with pytest.raises(Exception, match="expected ids"):
        index.add(spark.createDataFrame([(9, [1.0])], "id long, embedding array<float>")).vectors.collect()
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), x=1) == 0.0
    assert one(spark, V.byte_embedding(F.col("t"), 4), t="ab")[2:] == [0.0, 0.0]


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "hello_world foo", "greet"), (2, "foo bar foo", "bar"), (3, None, None)], "id long, text string, symbol string")
    index = lexical.Index.build(docs, "id", {"content": F.col("text"), "symbol": F.col("symbol")})
    ids = lambda q: [r["id"] for r in index.search(q, 10).collect()]
    assert ids("world") == [1] and ids("foo") == [2, 1] and ids('"foo bar"') == [2] and ids("symbol:bar") == [2] and ids("+foo -bar") == [1] and ids("") == []
    assert [r["id"] for r in index.delete(spark.createDataFrame([(1,)], "id long")).search("foo hello", 10).collect()] == [2]
    for bad in ('a "b', "nope:x"):
        with pytest.raises(lexical.QueryError):
            index.search(bad, 1)


def test_fusion(spark):
    rows = [("a", i, 1.0 - i / 10) for i in range(3)] + [("b", 1, 0.9), ("b", 0, 0.8), ("b", 7, 0.1)]
    lists = spark.createDataFrame(rows, "list string, id long, score double")
    top = [(r["id"], r["score"]) for r in fusion.top(fusion.reciprocal_rank(lists), 10).collect()]
    assert [i for i, _ in top] == [0, 1, 2, 7] and top[0][1] == pytest.approx(1 / 61 + 1 / 62) == pytest.approx(top[1][1])
    flat = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5)], "list string, id long, score double")
    assert [r["score"] for r in fusion.weighted(flat, {}).collect()] == [1.0, 1.0]
    assert fusion.two_weights(7) == {"lexical": 1.0, "semantic": 0.0}


def test_ranking(spark):
    rows = [(0, "a", "Other", 1.0), (1, "b", "get_user", 1.0), (2, "a", None, 1.0), (3, "c", "user", 1.0)]
    res = spark.createDataFrame([(r, f, s, "function", 1, 2, x, "", r) for r, f, s, x in rows], "rank int, file string, symbol string, kind string, start int, end int, score double, snippet string, chunk_id long")
    out = [(r["chunk_id"], round(r["score"], 4)) for r in ranking.rerank(res, "getUser").orderBy("rank").collect()]
    assert out == [(1, 1.25), (3, 1.1), (2, 1.05), (0, 1.0)]
    spans = [(0, "x", 1, 50), (1, "x", 20, 70), (2, "y", 1, 50), (3, "x", 60, 110), (4, "x", 9, 2)]
    res = spark.createDataFrame([(r, f, None, "block", a, b, 1.0, "", r) for r, f, a, b in spans], res.schema)
    assert sorted(r["rank"] for r in ranking.drop_overlaps(res).collect()) == [0, 2, 3, 4]


def test_changes(spark):
    schema = "path string, mtime long, size long, content_hash binary"
    old = spark.createDataFrame([("same", 1, 1, bytearray(b"a")), ("touched", 1, 1, bytearray(b"a")), ("edited", 1, 1, bytearray(b"a")), ("gone", 1, 1, bytearray(b"a"))], schema)
    new = spark.createDataFrame([("same", 1, 1, bytearray(b"z")), ("touched", 2, 1, bytearray(b"a")), ("edited", 2, 1, bytearray(b"b")), ("new", 1, 1, bytearray(b"a"))], schema)
    assert {(r["path"], r["change"]) for r in changes.detect(new, old).collect()} == {("new", "added"), ("edited", "modified"), ("gone", "deleted")}
    assert changes.detect(old, old).isEmpty()


def seed(spark, files, chunks, imports, calls):
    return (
        spark.createDataFrame(files, "file_id long, path string, lang string"),
        spark.createDataFrame(chunks, "chunk_id long, file_id long, symbol string, kind string, start_line int"),
        spark.createDataFrame(imports, "file_id long, ord int, source string, symbol string, alias string, is_default boolean"),
        spark.createDataFrame(calls, "call_id long, caller_chunk_id long, callee_name string, line int, column int, is_method boolean, receiver string"),
    )


def kinds(spark, *tables):
    files, chunks, imports, calls = seed(spark, *tables)
    resolved = resolve.resolve(calls, files, chunks, imports)
    return {r["call_id"]: (r["target_kind"], r["resolved_chunk_id"]) for r in resolve.classify(resolved, files, chunks, imports).collect()}


def test_resolution(spark):
    files = [(1, "a.ts", "typescript"), (2, "b.ts", "typescript"), (3, "c.py", "python"), (4, "pkg/m.py", "python"), (5, "lib/index.ts", ""), (6, "d.go", "go"), (7, "E.java", "java"), (8, "f.rs", "rust"), (9, "g.cpp", "cpp"), (10, "dup.ts", "typescript")]
    chunks = [(1, 1, "caller", "function", 1), (2, 2, "foo", "function", 1), (10, 10, "foo", "function", 1), (3, 3, "py", "function", 1), (4, 4, "run", "function", 1), (14, 10, "run", "function", 5), (5, 5, "only", "function", 1), (6, 6, "g", "function", 1), (7, 7, "j", "method", 1), (8, 8, "r", "function", 1), (9, 9, "c", "function", 1), (11, 1, "near", "function", 9)]
    imports = [(1, 0, "./b", "foo", None, False), (1, 1, "./lib", None, "Lib", True), (1, 2, "node:fs", "*", "fs", False), (1, 3, "lodash", "map", None, False), (3, 0, "pkg.m", "run", "go", False), (3, 1, "os", None, "os", False), (3, 2, "requests", None, "requests", False), (6, 0, "fmt", "fmt", None, False), (6, 1, "github.com/x/y", "y", None, False), (7, 0, "java.util", "Collections", None, False), (9, 0, "algorithm", None, None, False)]
    calls = [
        (1, 1, "foo", 1, 1, False, None), (2, 1, "Lib", 1, 2, False, None), (3, 1, "readFileSync", 1, 3, True, "fs"), (4, 1, "map", 1, 4, False, None), (5, 1, "near", 1, 5, False, None), (6, 1, "log", 1, 6, True, "console"), (7, 1, "nope", 1, 7, False, None),
        (8, 3, "go", 1, 1, False, None), (9, 3, "join", 1, 2, True, "os.path"), (10, 3, "get", 1, 3, True, "requests"), (11, 3, "print", 1, 4, False, None), (12, 3, "print", 1, 5, True, "x"),
        (13, 6, "Println", 1, 1, True, "fmt"), (14, 6, "len", 1, 2, False, None), (15, 6, "Z", 1, 3, True, "y"), (16, 7, "sort", 1, 1, True, "Collections"), (17, 7, "println", 1, 2, True, "System.out"), (18, 8, "drop", 1, 1, False, "std::mem"), (19, 9, "sort", 1, 1, False, None),
    ]
    got = kinds(spark, files, chunks, imports, calls)
    assert got == {1: ("project", 2), 2: ("project", 5), 3: ("stdlib", None), 4: ("external", None), 5: ("project", 11), 6: ("builtin", None), 7: ("unresolved", None), 8: ("project", 4), 9: ("stdlib", None), 10: ("external", None), 11: ("builtin", None), 12: ("unresolved", None), 13: ("stdlib", None), 14: ("builtin", None), 15: ("external", None), 16: ("stdlib", None), 17: ("stdlib", None), 18: ("stdlib", None), 19: ("stdlib", None)}
    f, c, i, k = seed(spark, files, chunks, imports, calls)
    done = resolve.resolve(k, f, c, i)
    assert [r["caller_file"] for r in resolve.callers("near", done, f, c).collect()] == ["a.ts"]
    assert [r["callee_name"] for r in resolve.callers("nope", done, f, c).collect()] == ["nope"]
    assert resolve.callers_in_file("foo", "dup.ts", done, f, c).isEmpty()
    with pytest.raises(resolve.NotFound):
        resolve.root_chunk("absent", f, c)
    with pytest.raises(resolve.Ambiguous):
        resolve.root_chunk("foo", f, c)
    assert resolve.root_chunk("foo", f, c, "b.ts") == 2


def test_graph_repeats_cycles(spark):
    files, chunks, _, _ = seed(spark, [(1, "a.py", "python")], [(1, 1, "a", "function", 1), (2, 1, "b", "function", 5)], [], [])
    calls = spark.createDataFrame([(1, 1, "b", 2, 1, False, None, 2, "project"), (2, 2, "a", 6, 1, False, None, 1, "project"), (3, 2, "x", 7, 1, True, "o", None, "unresolved")], "call_id long, caller_chunk_id long, callee_name string, line int, column int, is_method boolean, receiver string, resolved_chunk_id long, target_kind string")
    nodes, edges = graph.build(calls, spark.createDataFrame([(1,)], "chunk_id long"), files, chunks, 3)
    assert [(r["id"], r["symbol"], r["depth"]) for r in nodes.orderBy("id").collect()] == [(1, "a", 0), (2, "b", 1), (3, "o.x", 2)]
    assert sorted((r["from"], r["to"]) for r in edges.collect()) == [(1, 2), (1, 2), (2, 1), (2, 3)]
    assert "digraph" in output.dot(nodes, edges) and output.graph_pretty(nodes, edges).count("->") == 4
    nodes, edges = graph.build(calls, spark.createDataFrame([(1,)], "chunk_id long"), files, chunks, 0)
    assert nodes.count() == 1 and edges.isEmpty() and output.graph_pretty(nodes, edges) == "a"


def test_formats(spark):
    res = spark.createDataFrame([(0, "f", None, "block", 1, 9, 0.5, "a\nb\nc", 7), (1, "g", "s", "function", 1, 2, 0.4, "x", None)], "rank int, file string, symbol string, kind string, start int, end int, score double, snippet string, chunk_id long")
    full = [r["line"] for r in output.results_jsonl(res, 2).collect()]
    assert '"symbol":null' in full[0] and "a\\nb\\n..." in full[0] and "chunk_id" not in full[1]
    compact = [r["line"] for r in output.results_compact(res).collect()]
    assert "symbol" not in compact[0] and "snippet" not in compact[1]
    assert "1. 0.500 f:1-9 -" in output.results_pretty(res, "q", "lexical")


def test_config(tmp_path):
    c = Config.of({"profile": "light", "search": {"rrf_k": 10, "unknown": 1}})
    (tmp_path / "c.toml").write_text(c.dump())
    assert Config.load(tmp_path / "c.toml") == c and c.search.rrf_k == 10 and Config.load_or_default(tmp_path / "none") == Config()
    r = ModelRegistry()
    r.register(Model("mine", 3))
    r.save(tmp_path / "m.json")
    assert ModelRegistry.load(tmp_path / "m.json").get("mine").dimensions == 3 and r.get("none") is None
    assert search_type("BM25") == "lexical"
    with pytest.raises(ValueError):
        search_type("fuzzy")


def test_numbering(spark):
    from quarry.plans.numbering import number

    df = spark.createDataFrame([(i * 7919 % 1009, "x") for i in range(1009)], "k long, v string").repartition(5)
    assert [(r["k"], r["n"]) for r in number(df, ["k"], "n", 10).orderBy("k").collect()] == [(k, k + 10) for k in range(1009)]
    assert number(df.limit(0), ["k"], "n").count() == 0
