"""Source parsers: text and language to chunks, call sites and imports.

``parse`` returns a ``Parsed``; a language without a parser, or a text in which none of its declarations is
found, gives no chunks, and the caller falls back to line windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Call:
    callee_name: str
    line: int
    column: int | None
    is_method: bool
    receiver: str | None


@dataclass
class Chunk:
    symbol: str | None
    kind: str
    start_line: int
    end_line: int
    content: str
    parent: str | None = None
    calls: list[Call] = field(default_factory=list)


@dataclass
class Import:
    source: str
    symbol: str | None = None
    alias: str | None = None
    is_default: bool = False


@dataclass
class Parsed:
    chunks: list[Chunk] = field(default_factory=list)
    #: The last import of the file comes first: it is the one that binds.
    imports: list[Import] = field(default_factory=list)
    #: Calls of the whole file, for the fallback chunk.
    calls: list[Call] = field(default_factory=list)


def parse(text: str, language: str | None) -> Parsed:
    from quarry.parsers import braces, python

    if language == "python":
        out = python.parse(text)
    elif language in braces.LANGUAGES:
        out = braces.parse(text, language)
    else:
        return Parsed()
    out.chunks.sort(key=lambda c: c.start_line)
    out.imports.reverse()
    return out
