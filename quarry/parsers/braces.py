"""Languages with braces: JavaScript and TypeScript, Java, Go, Rust, C and C++.

Comments and strings are blanked out, brackets matched, and every braced block is told by the words before it.
This is no grammar: declarations of usual form are found, macros and conditional compilation are not seen
through, and a text whose brackets do not match is read as far as they do.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from quarry.parsers import Call, Chunk, Import, Parsed

SCRIPT = ("typescript", "javascript", "tsx", "jsx")
LANGUAGES = (*SCRIPT, "java", "go", "rust", "c", "cpp")

_NAME = r"[A-Za-z_$][\w$]*"
_COMMON = "if for while switch catch return do else try finally case"
_WORDS = {
    "java": "new synchronized super this assert throw", "go": "func defer select range go", "rust": "fn match loop unsafe impl where in as move",
    "c": "sizeof alignof", "cpp": "sizeof alignof decltype static_assert new delete throw noexcept",
} | dict.fromkeys(SCRIPT, "function typeof await async void delete new in of instanceof yield throw super with import")
_CONTROL = {lang: frozenset(f"{_COMMON} {more}".split()) for lang, more in _WORDS.items()}
_TOKEN = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<tick>`(?:\\.|[^`\\])*`?)|(?P<raw>r\#*")"""
    r"""|(?P<text>"(?:\\.|[^"\\\n])*"?)|(?P<char>'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')|(?P<single>'(?:\\.|[^'\\\n])*')""",
    re.S,
)


@dataclass
class _Source:
    text: str
    plain: str
    comments: list[tuple[int, int]]
    match: dict[int, int]
    starts: list[int]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1] + 1


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def _read(text: str, language: str) -> _Source:
    out, comments, at = [], [], 0
    while m := _TOKEN.search(text, at):
        kind, end = m.lastgroup, m.end()
        if kind == "raw":
            close = text.find('"' + "#" * (len(m[0]) - 2), end) if language == "rust" else -1
            if close < 0:
                out.append(text[at : m.start() + 1])
                at = m.start() + 1
                continue
            end = close + len(m[0]) - 1
        if (kind == "single" and language not in SCRIPT) or (kind == "tick" and language not in (*SCRIPT, "go")):
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
            continue
        if kind in ("line", "block"):
            comments.append((m.start(), end))
            out.append(text[at : m.start()] + _blank(text[m.start() : end]))
        else:  # the quotes stay, so that a string can still be told from nothing
            out.append(text[at : m.start()] + '"' + _blank(text[m.start() + 1 : end - 1]) + ('"' if end - m.start() > 1 else ""))
        at = end
    plain = "".join(out) + text[at:]
    match: dict[int, int] = {}
    stack: list[int] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", plain):
        if m[0] in "([{":
            stack.append(m.start())
        else:
            while stack and plain[stack[-1]] != pairs[m[0]]:
                stack.pop()
            if stack:
                match[stack[-1]], match[m.start()] = m.start(), stack[-1]
                stack.pop()
    return _Source(text, plain, comments, match, [0, *(m.end() for m in re.finditer("\n", text))])


def _header_start(s: _Source, brace: int) -> int:
    """Where the statement begins whose block opens at ``brace``."""
    i = brace - 1
    while i >= 0:
        c = s.plain[i]
        if c in ")]" and i in s.match:
            i = s.match[i] - 1
            continue
        if c in ";{}(,[":
            break
        i -= 1
    i += 1
    while i < brace and s.plain[i].isspace():
        i += 1
    return i


@dataclass
class _Block:
    kind: str
    name: str | None
    start: int
    end: int
    open: int
    parent: str | None = None
    header: tuple[int, int] = (0, 0)


def _script(s: _Source, at: int, brace: int, inside: _Block | None) -> _Block | None:
    head = s.plain[at:brace]
    end = s.match[brace] + 1
    if m := re.search(rf"\bclass(?:\s+({_NAME}))?(?=[\s<]|$)", head):
        if not re.search(r"=>\s*$", head):
            return _Block("class", m[1] if m[1] not in ("extends", "implements") else None, at + m.start(), end, brace)
    if m := re.search(rf"(?:\basync\s+)?\bfunction\b\s*\*?\s*({_NAME})?\s*(?:<[^()]*>)?\s*\(", head):
        return _Block("function", m[1] or _bound_name(head[: m.start()]), at + m.start(), end, brace)
    if re.search(r"=>\s*$", head):
        return _arrow(s, at, at + head.rindex("=>"), end, brace)
    close = head.rfind(")")
    first = s.match.get(at + close) if close >= 0 else None
    if first is None or first < at or not re.fullmatch(r"\s*(?::[^=;]*)?", head[close + 1 :]):
        return None
    words = r"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare)\s+)*"
    m = re.search(rf"({words})[*#]?({_NAME})\s*(?:<[^()]*>)?\s*$", head[: first - at])
    if m is None or m[2] in _CONTROL["javascript"]:
        return None
    if inside is not None and inside.kind == "class" or not head[: m.start()].strip():  # of a class, or of an object literal
        return _Block("method", m[2], at + m.start(), end, brace)
    return None


def _bound_name(before: str) -> str | None:
    """The name that a function expression is assigned to."""
    if m := re.search(rf"(?:\b(?:const|let|var)\s+)?({_NAME})\s*(?::[^=;]*)?=\s*(?:async\s*)?$", before):
        return m[1]
    m = re.search(rf"({_NAME})\s*:\s*(?:async\s*)?$", before)
    return m[1] if m else None


def _arrow(s: _Source, low: int, sign: int, end: int, open_: int) -> _Block:
    """An arrow function whose ``=>`` stands at ``sign``."""
    i = sign - 1
    while i > 0 and s.plain[i].isspace():
        i -= 1
    colon = s.plain.rfind("):", low, sign)
    if s.plain[i] != ")" and colon >= 0 and not re.search(r"[{(;=\n]", s.plain[colon + 2 : sign]):
        i = colon  # a return type stands between
    start = s.match.get(i, i) if s.plain[i] == ")" else i
    if s.plain[i] != ")":
        while start > 0 and re.match(r"[\w$]", s.plain[start - 1]):
            start -= 1
    if m := re.search(r"\basync\s*$", s.plain[max(0, start - 8) : start]):
        start = max(0, start - 8) + m.start()
    line = max(s.plain.rfind(c, 0, start) for c in ";{}")
    return _Block("function", _bound_name(s.plain[max(line + 1, start - 400) : start]), start, end, open_)


def _expression_arrows(s: _Source) -> list[_Block]:
    out = []
    for m in re.finditer(r"=>\s*(?=[^\s{])", s.plain):
        i, n = m.end(), len(s.plain)
        while i < n:
            c = s.plain[i]
            if c in "([{" and i in s.match:
                i = s.match[i]
            elif c in ",;)]}" or (c == "\n" and not re.match(r"\s*[.?:&|+*/=<>-]", s.plain[i:])):
                break
            i += 1
        out.append(_arrow(s, max(0, m.start() - 400), m.start(), i, m.start()))
    return out


def _java(s: _Source, at: int, brace: int, inside: _Block | None) -> _Block | None:
    head, end = s.plain[at:brace], s.match[brace] + 1
    if m := re.search(rf"\b(class|interface|enum|record)\s+({_NAME})", head):
        return _Block({"class": "class", "interface": "interface"}.get(m[1], "scope"), m[2], at, end, brace)
    if inside is not None and inside.kind in ("class", "interface", "scope"):
        close = head.rfind(")")
        first = s.match.get(at + close) if close >= 0 else None
        if first is None or first < at or not re.fullmatch(r"\s*(?:throws\s+[\w.,\s]+)?", head[close + 1 :]):
            return None
        before = head[: first - at]
        m = re.search(rf"({_NAME})\s*$", before)
        if m and m[1] not in _CONTROL["java"] and not re.search(r"\bnew\b|=|\.\s*$|@\s*$", re.sub(r"@\w+\([^)]*\)", "", before[: m.start()])):
            return _Block("method", m[1], at, end, brace)
    return None


def _go(s: _Source, at: int, brace: int, inside: _Block | None) -> _Block | None:
    lines = [m for m in re.finditer(r"(?m)^(?=func\b|type\b)", s.plain[at:brace])]  # a line end ends a statement
    if not lines:
        return None
    at += lines[-1].start()
    head, end = s.plain[at:brace], s.match[brace] + 1
    if m := re.match(rf"func\s*\(\s*(?:{_NAME}\s+)?\*?\s*({_NAME})[^)]*\)\s*({_NAME})\s*[\[(]", head):
        return _Block("method", m[2], at, end, brace, m[1])
    if m := re.match(rf"func\s+({_NAME})\s*[\[(]", head):
        return _Block("function", m[1], at, end, brace)
    if m := re.match(rf"type\s+({_NAME})\b", head):
        return _Block("struct", m[1], at, end, brace)
    return None


def _rust(s: _Source, at: int, brace: int, inside: _Block | None) -> _Block | None:
    head, end = re.sub(r"#\[[^\]]*\]", lambda m: " " * len(m[0]), s.plain[at:brace]), s.match[brace] + 1
    start = at + len(head) - len(head.lstrip())
    head = head.lstrip()
    if m := re.match(rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern|default)\s+(?:\"[^\"]*\"\s+)?)*fn\s+({_NAME})", head):
        return _Block("method" if inside is not None and inside.kind in ("class", "interface") else "function", m[1], start, end, brace)
    if m := re.match(r"(?:unsafe\s+)?impl\b\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*(.*)", head, re.S):
        name = re.search(rf"(?:[\w]+::)*({_NAME})", re.sub(r"^[!&\s]*(?:dyn\s+)?", "", m[1]))
        return _Block("class", name[1] if name else None, start, end, brace)
    if m := re.match(rf"(?:pub(?:\([^)]*\))?\s+)?(struct|(?:unsafe\s+)?trait)\s+({_NAME})", head):
        return _Block("struct" if m[1] == "struct" else "interface", m[2], start, end, brace)
    return None


def _c(s: _Source, at: int, brace: int, inside: _Block | None) -> _Block | None:
    head, end = s.plain[at:brace], s.match[brace] + 1
    head = re.sub(r"^(?:\s*#[^\n]*\n)+", lambda m: " " * len(m[0]), head)
    start = at + len(head) - len(head.lstrip())
    head = re.sub(r"^(?:(?:public|private|protected)\s*:\s*)+", "", head.lstrip())
    if (m := re.search(rf"\bstruct\s+({_NAME})[^()=]*$", head)) or (m := re.search(r"\bstruct\s*()$", head)):
        return _Block("struct", m[1] or None, start + head.index("struct"), end, brace)
    if re.match(r"(?:class|namespace|union|enum|extern)\b", head):
        return _Block("scope", None, start, end, brace)
    m = re.search(rf"((?:{_NAME}\s*::\s*)*(?:~?{_NAME}|operator\s*\S+))\s*\([^{{}};]*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>*& ]+|:[^;{{]*|\s)*$", head)
    if m and re.split(r"::", m[1])[-1].strip() not in _CONTROL["cpp"] and "=" not in head[: m.start()]:
        return _Block("function", re.split(r"\s*::\s*", m[1])[-1].strip(), start, end, brace)
    return None


_TELL = {"java": _java, "go": _go, "rust": _rust, "c": _c, "cpp": _c} | dict.fromkeys(SCRIPT, _script)


def parse(text: str, language: str) -> Parsed:
    s = _read(text, language)
    blocks: list[_Block] = []
    open_blocks: list[_Block] = []
    tell = _TELL[language]
    for m in re.finditer(r"\{", s.plain):
        brace = m.start()
        if brace not in s.match:
            continue
        while open_blocks and open_blocks[-1].end <= brace:
            open_blocks.pop()
        inside = open_blocks[-1] if open_blocks else None
        start = _header_start(s, brace)
        found = tell(s, start, brace, inside)
        if found is None:
            if inside is not None:  # a plain block hides the class around it from what it holds
                open_blocks.append(_Block("plain", inside.name, brace, s.match[brace] + 1, brace))
            continue
        open_blocks.append(found)
        if found.kind != "scope":
            blocks.append(found)
    if language in SCRIPT:
        blocks += _expression_arrows(s)
    if language == "rust":
        blocks += [_Block("struct", m[1], m.start(), m.end(), m.end()) for m in re.finditer(rf"(?:\bpub(?:\([^)]*\))?\s+)?\bstruct\s+({_NAME})[^{{}};]*;", s.plain)]
    if language == "go":
        blocks += [_Block("struct", m[1], m.start(), m.end(), m.end()) for m in re.finditer(rf"(?m)^type\s+({_NAME})\s+[^{{}}\n(]+$", s.plain)]
    if language == "java":
        blocks += [_Block("method", m[1], m.start() + 1, m.end(), m.end()) for m in re.finditer(rf"(?<=[;{{}}])\s*(?:[\w<>\[\],.?]+\s+)+({_NAME})\s*\([^{{}};()]*\)\s*(?:throws\s+[\w.,\s]+)?;", s.plain) if _inside_interface(blocks, m.start())]
    out = Parsed()
    blocks.sort(key=lambda b: (b.start, -b.end))
    containers: list[_Block] = []
    chunks: list[tuple[_Block, Chunk]] = []
    for b in blocks:
        while containers and containers[-1].end <= b.start:
            containers.pop()
        parent = b.parent or next((c.name for c in reversed(containers) if c.kind in ("class", "struct", "interface")), None)
        top = _with_comments(s, b.start)
        chunk = Chunk(b.name, b.kind, s.line(top), s.line(max(b.end - 1, b.start)), text[top : b.end], parent)
        out.chunks.append(chunk)
        chunks.append((b, chunk))
        containers.append(b)
    heads = {b.open for b in blocks}
    for at, call in _calls(s, language, blocks, heads):
        out.calls.append(call)
        owner = max(((b, c) for b, c in chunks if b.start <= at < b.end), key=lambda x: x[0].start, default=None)
        if owner is not None and owner[0].kind in ("function", "method"):
            owner[1].calls.append(call)
    out.imports = _imports(s, language)
    return out


def _inside_interface(blocks: list[_Block], at: int) -> bool:
    around = [b for b in blocks if b.open < at < b.end]
    return bool(around) and max(around, key=lambda b: b.open).kind == "interface"


def _with_comments(s: _Source, start: int) -> int:
    """The start of the comments above, with nothing but white space between."""
    top = start
    for a, b in reversed(s.comments[: bisect.bisect_left(s.comments, (start, 0))]):
        if s.text[b:top].strip():
            break
        top = a
    return top


_CALL = re.compile(rf"({_NAME})\s*(?:::)?(?:<[\w\s,:<>&'*\[\].]*>)?\s*(?:\?\.)?\(")


def _calls(s: _Source, language: str, blocks: list[_Block], heads: set[int]):
    declared = set()
    for b in blocks:
        if b.name:
            found = re.compile(rf"\b{re.escape(b.name)}\s*(?:<[^()]*>)?\s*[(\[]").search(s.plain, b.start, max(b.open, b.start) + 1)
            if found and b.kind in ("function", "method"):
                declared.add(found.start())
    for m in _CALL.finditer(s.plain):
        name, at = m[1], m.start()
        if name in _CONTROL[language] or at in declared or (language in SCRIPT and name == "require" and s.plain[at - 1 : at] != "."):
            continue
        before = s.plain[:at].rstrip() if at and s.plain[at - 1].isspace() else s.plain[:at]
        before = before[-400:]
        if before.endswith("@") or re.search(r"\b(?:new|function|fn|func|class|def)\s*\*?$", before):
            continue
        if language in ("java", "c", "cpp") and re.search(r"[\w>*&\]]\s+\**$", s.plain[max(0, at - 80) : at]) and not re.search(r"\b(?:return|else|throw|do|case)\s+$", s.plain[max(0, at - 80) : at]):
            continue  # a type before the name: a declaration
        sign = next((x for x in ("?.", "->", "::", ".") if before.endswith(x)), None)
        if sign is None:
            yield at, Call(name, s.line(at), s.column(at), False, None)
            continue
        low = _receiver_start(s, at - (len(s.plain[:at]) - len(s.plain[:at].rstrip())) - len(sign))
        receiver = s.text[low : at].rstrip().removesuffix(sign).strip()
        if not receiver:
            continue
        path = sign == "::"
        if language == "go" and receiver.startswith("."):
            continue
        yield low, Call(name, s.line(low), s.column(low), not path or language not in ("rust", "c", "cpp"), receiver)


def _receiver_start(s: _Source, end: int) -> int:
    i = end - 1
    while i >= 0:
        c = s.plain[i]
        if c in ")]" and i in s.match:
            i = s.match[i] - 1
        elif re.match(r"[\w$.?]", c) or c in '"':
            i -= 1
        elif c == ":" and s.plain[i - 1 : i + 1] == "::":
            i -= 2
        elif c == ">" and s.plain[i - 1 : i + 1] == "->":
            i -= 2
        elif c.isspace() and re.match(r"\s*(?:\.|\?\.|->)", s.plain[i:end]) and re.search(r"[\w)\]]\s*$", s.plain[max(0, i - 200) : i + 1]):
            i -= 1
        else:
            break
    low = i + 1
    while low < end and s.plain[low].isspace():
        low += 1
    if m := re.match(r"(?:return|await|throw|yield|else|case|new)\s+", s.plain[low:end]):
        low += m.end()
    return low


def _quoted(s: _Source, at: int) -> str:
    """The string literal that starts at ``at``."""
    close = s.text.find(s.text[at], at + 1)
    return s.text[at + 1 : close] if close > 0 else ""


def _imports(s: _Source, language: str) -> list[Import]:
    out: list[Import] = []
    if language in SCRIPT:
        for m in re.finditer(r'(?m)^\s*import\s+(?:type\s+)?([^"\';]*?)\s*\bfrom\s*(?=["\'])', s.plain):
            source, clause = _quoted(s, m.end()), m[1]
            if b := re.search(r"\{(.*)\}", clause, re.S):
                for item in filter(None, (x.strip().removeprefix("type ") for x in b[1].split(","))):
                    name, _, alias = (x.strip() for x in item.partition(" as "))
                    out.append(Import(source, name, alias or None))
            outer = re.sub(r"\{.*\}", "", clause, flags=re.S)
            for item in filter(None, (x.strip() for x in outer.split(","))):
                if n := re.match(rf"\*\s+as\s+({_NAME})", item):
                    out.append(Import(source, "*", n[1]))
                elif re.fullmatch(_NAME, item):
                    out.append(Import(source, None, item, True))
        for m in re.finditer(rf'(?:\b(?:const|let|var)\s+(\{{[^}}]*\}}|{_NAME})\s*=\s*)?\brequire\s*\(\s*(?=["\'])', s.plain):
            source = _quoted(s, m.end())
            if m[1] is None:
                out.append(Import(source))
            elif m[1].startswith("{"):
                for item in filter(None, (x.strip() for x in m[1][1:-1].split(","))):
                    name, _, alias = (x.strip() for x in item.partition(":"))
                    out.append(Import(source, name, alias or None))
            else:
                out.append(Import(source, "*", m[1]))
    elif language == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", s.plain):
            package, _, name = m[2].rpartition(".")
            out.append(Import(m[2], "*") if m[3] else Import(package, name))
    elif language == "go":
        specs = [(m.start(1), m.end(1)) for m in re.finditer(r"\bimport\s*\(([^)]*)\)", s.plain)] + [(m.end(), s.text.find("\n", m.end()) % (len(s.text) + 1)) for m in re.finditer(r"(?m)^import\s+(?=[^(\s])", s.plain)]
        for a, b in specs:
            for m in re.finditer(rf'({_NAME}|\.)?[ \t]*"', s.plain[a:b]):
                if s.plain[a : a + m.start()].count('"') % 2:
                    continue
                source = _quoted(s, a + m.end() - 1)
                alias = m[1] if m[1] and m[1] not in ("_", ".") else None
                out.append(Import(source, source.rsplit("/", 1)[-1] if alias is None else None, alias))
    elif language == "rust":
        for m in re.finditer(r"(?:\bpub(?:\([^)]*\))?\s+)?\buse\s+([^;]+);", s.plain):
            _use_tree(" ".join(m[1].split()), "", out)
    else:
        for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", s.text):
            out.append(Import(m[1].strip()))
    return out


def _use_tree(tree: str, prefix: str, out: list[Import]) -> None:
    tree = tree.strip()
    if tree.endswith("}") and "{" in tree:
        head, inner = tree[: tree.index("{")].strip().removesuffix("::"), tree[tree.index("{") + 1 : -1]
        base = "::".join(filter(None, (prefix, head)))
        depth, item = 0, ""
        for c in inner + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                if item.strip():
                    _use_tree(item, base, out)
                item = ""
            else:
                item += c
        return
    path, _, alias = (x.strip() for x in tree.partition(" as "))
    if path == "self":
        source, _, name = prefix.rpartition("::")
        out.append(Import(source or prefix, name, alias or None))
        return
    head, _, name = path.rpartition("::")
    out.append(Import("::".join(filter(None, (prefix, head))) or name, name, alias or None))
