"""Paths: languages by extension, ignore patterns, posix names."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGE_OF = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx",
    "py": "python", "pyi": "python", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "go": "go",
    "html": "html", "htm": "html", "vue": "html", "css": "css", "scss": "scss", "sass": "scss",
    "json": "json", "yaml": "yaml", "yml": "yaml",
}
#: Languages that a parser cuts into functions and classes.
PARSED = ("typescript", "javascript", "tsx", "jsx", "python", "rust", "java", "c", "cpp", "go")
JAVASCRIPT = ("typescript", "javascript", "tsx", "jsx")

# What is not walked unless asked for.
EXCLUDED_DIRS = (
    ".git", "node_modules", "target", "dist", "build", ".next", ".nuxt", "vendor", ".venv", "venv", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".tox", ".eggs", "*.egg-info", ".cargo", ".rustup", "coverage", ".nyc_output", ".quarry",
)
EXCLUDED_FILES = (
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock",
    "*.wasm", "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.o", "*.a", "*.pyc", "*.pyo",
)


def extension(path: Column) -> Column:
    """The lower-case extension of the last segment, null if there is none; a leading dot starts no extension."""
    found = F.regexp_extract(F.lower(path), r"[^/]\.([^./]*)$", 1)
    return F.when(found != "", found)


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.try_element_at(table, extension(path))


def parsed_language(path: Column) -> Column:
    """The language by path among those with a parser."""
    found = language(path)
    return F.when(found.isin(*PARSED), found)


def stored_language(lang: Column, path: Column) -> Column:
    """The stored language, or that of the path where none is stored."""
    return F.when(F.coalesce(F.trim(lang), F.lit("")) != "", F.lower(lang)).otherwise(F.coalesce(parsed_language(path), F.lit("")))


def extension_filter(path: Column, wanted: list[str]) -> Column:
    """Whether the extension is wanted; a list without a name wants all."""
    names = sorted({w.strip().lstrip(".").lower() for w in wanted} - {""})
    return extension(path).isin(*names) if names else F.lit(True)


class PatternError(ValueError):
    """An ignore pattern that cannot be read."""


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over a relative path with forward slashes."""
    body = pattern.strip()
    only_dir, body = body.endswith("/"), body.rstrip("/")
    anchored, body = "/" in body, body.lstrip("/")
    if not body:
        raise PatternError(f"empty pattern: {pattern!r}")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = body.find("]", i + 2)
            if end < 0:
                raise PatternError(f"unclosed class: {pattern!r}")
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching pattern excludes a path; ``!`` takes a path back in."""
    out = F.lit(False)
    for line in patterns:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        back = text.startswith("!")
        out = F.when(path.rlike(glob_regex(text[1:] if back else text)), F.lit(not back)).otherwise(out)
    return out


def default_excluded(path: Column) -> Column:
    """Whether a default directory or file pattern applies."""
    dirs = "|".join(glob_regex(d + "/") for d in EXCLUDED_DIRS)
    files = "|".join(glob_regex(f)[: -len("(?:/|$)")] + "$" for f in EXCLUDED_FILES)
    return path.rlike(dirs) | path.rlike(files)


def dirname(path: Column) -> Column:
    unix = F.regexp_replace(path, r"\\", "/")
    return F.when(F.instr(unix, "/") > 0, F.regexp_replace(unix, "/[^/]*$", "")).otherwise(F.lit(""))


def normalize(path: Column) -> Column:
    """Without empty segments and ``.``; ``..`` takes back a segment, or nothing at the root."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/", -1)
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def join(base: Column, relative: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(base, r"\\", "/"), "/+$", "")
    return normalize(F.when(stem == "", relative).otherwise(F.concat(stem, F.lit("/"), relative)))


def has_extension(path: Column) -> Column:
    return F.instr(F.element_at(F.split(path, "/", -1), -1), ".") > 0


def relative_to(root: str, path: Column) -> Column:
    """``path`` (a local path or file URI) below ``root``, with forward slashes."""
    base = PurePosixPath(root).as_posix().rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^" + re.escape(base) + "/", "")
