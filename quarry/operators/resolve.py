"""Resolving call sites to chunks, and telling project, builtin, standard-library and external targets apart.

Everything is set-based: uniqueness is one grouped count per key, the import cascade a union of prioritised joins of
which each call keeps the best.  Tables: ``files(file_id, path, lang)``, ``chunks(chunk_id, file_id, symbol, kind,
start_line)``, ``imports(file_id, ord, source, symbol, alias, is_default)``, ``calls(call_id, caller_chunk_id,
callee_name, line, column, is_method, receiver)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import resources as R
from quarry.functions import paths as P
from quarry.functions.text import leading_identifier

PROJECT, BUILTIN, STDLIB, EXTERNAL, UNRESOLVED = "project", "builtin", "stdlib", "external", "unresolved"
_JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def unique_symbols(chunks: DataFrame) -> DataFrame:
    """``symbol, chunk_id`` of symbols that exactly one chunk bears."""
    return chunks.where("symbol is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n = 1").drop("n")


def unique_symbols_in_file(chunks: DataFrame) -> DataFrame:
    found = chunks.where("symbol is not null").groupBy("file_id", "symbol").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"))
    return found.where("n = 1").drop("n")


def only_functions(chunks: DataFrame) -> DataFrame:
    """``file_id, chunk_id`` of files with exactly one function."""
    found = chunks.where("kind = 'function'").groupBy("file_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"))
    return found.where("n = 1").drop("n")


def import_paths(path: Column, lang: Column, source: Column) -> Column:
    """The files that an import may mean, in the order they are tried."""
    unix = F.regexp_replace(source, r"\\", "/")
    relative = unix.startswith("./") | unix.startswith("../")
    base = F.when(relative, P.join(P.dirname(path), unix)).when(unix.startswith("/"), P.normalize(unix))
    tried = F.array_sort(F.array_distinct(F.array(*(F.concat(base, F.lit(end)) for e in _JS_EXTENSIONS for end in (f".{e}", f"/index.{e}")))))
    none = F.array().cast("array<string>")
    script = F.when(base.isNull(), none).when(P.has_extension(base), F.array(base)).otherwise(tried)
    module = F.regexp_replace(source, r"\.", "/")
    python = F.when(source.startswith("."), none).otherwise(F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py"))))
    return F.when(source == "", none).when(lang.isin(*P.JAVASCRIPT), script).when(lang == "python", python).otherwise(none)


def local_imports(imports: DataFrame) -> DataFrame:
    """Imports under the name they are bound to in their file."""
    return imports.withColumn("local", F.coalesce("alias", "symbol")).where("local is not null")


def _via_imports(calls: DataFrame, files: DataFrame, chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """``call_id, chunk_id``: the first success along each call's imports and their candidate paths."""
    bound = local_imports(imports).select("file_id", "local", F.col("ord").alias("imp"), "source", F.col("symbol").alias("imported"), F.coalesce("is_default", F.lit(False)).alias("is_default"))
    names = bound.select("file_id", F.col("local").alias("__bound")).distinct()
    whole = F.trim("receiver")
    keyed = calls.join(names, (calls["file_id"] == names["file_id"]) & (whole == F.col("__bound")), "left").select(calls["*"], "__bound")
    key = F.when(~F.col("is_method"), F.col("callee_name")).when(F.col("__bound").isNotNull(), whole).otherwise(leading_identifier(F.col("receiver")))
    tried = keyed.withColumn("local", key).join(bound, ["file_id", "local"])
    named = F.col("imported").isNotNull() & (F.col("imported") != "*")
    desired = F.when(F.col("is_method"), F.col("callee_name")).when(named, F.col("imported")).when(F.col("is_default"), F.col("callee_name"))
    tried = tried.withColumn("desired", desired).where("desired is not null")
    at = tried.select("*", F.posexplode_outer(import_paths(F.col("path"), F.col("lang"), F.col("source"))).alias("at", "candidate"))
    there = files.select(F.col("path").alias("candidate"), F.col("file_id").alias("target"))
    met = at.where("candidate is not null").join(there, "candidate")
    in_file = unique_symbols_in_file(chunks).select(F.col("file_id").alias("target"), F.col("symbol").alias("desired"), "chunk_id")
    by_name = met.join(in_file, ["target", "desired"]).select("call_id", "imp", "at", F.lit(0).alias("step"), "chunk_id")
    lone = only_functions(chunks).select(F.col("file_id").alias("target"), "chunk_id")
    by_default = met.where(F.col("is_default") & F.col("imported").isNull()).join(lone, "target").select("call_id", "imp", "at", F.lit(1).alias("step"), "chunk_id")
    anywhere = unique_symbols(chunks).withColumnRenamed("symbol", "desired")
    late = tried.where(~F.col("is_method")).join(anywhere, "desired").select("call_id", "imp", F.lit(1 << 30).alias("at"), F.lit(2).alias("step"), "chunk_id")
    order = F.struct("imp", "at", "step", "chunk_id")
    return by_name.unionByName(by_default).unionByName(late).groupBy("call_id").agg(F.min(order).alias("first")).select("call_id", F.col("first.chunk_id").alias("via_import"))


def resolve(calls: DataFrame, files: DataFrame, chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` with ``resolved_chunk_id``: the same file's unique symbol, else by imports, else the project's unique symbol."""
    where = chunks.select(F.col("chunk_id").alias("caller_chunk_id"), "file_id")
    paths = files.select("file_id", "path", P.stored_language(F.col("lang"), F.col("path")).alias("lang"))
    placed = calls.drop("resolved_chunk_id").join(where, "caller_chunk_id").join(paths, "file_id")
    here = unique_symbols_in_file(chunks).select("file_id", F.col("symbol").alias("callee_name"), F.col("chunk_id").alias("in_file"))
    anywhere = unique_symbols(chunks).select(F.col("symbol").alias("callee_name"), F.col("chunk_id").alias("anywhere"))
    via = _via_imports(placed, files, chunks, imports)
    out = placed.join(here, ["file_id", "callee_name"], "left").join(via, "call_id", "left").join(anywhere, "callee_name", "left")
    kept = [c for c in calls.columns if c != "resolved_chunk_id"]
    return out.select(*kept, F.coalesce("in_file", "via_import", "anywhere").alias("resolved_chunk_id"))

#: Bytes of unique symbols that are broadcast; more meet the names that are called by shuffle.
BROADCAST_BYTES = 8 << 20
_OWN, _BY_NAME, _BY_DEFAULT, _LATE = -1, 0, 1, 2


def _named(i: Column) -> Column:
    return i["symbol"].isNotNull() & (i["symbol"] != "*")


def _desired(i: Column) -> Column:
    """The symbol that a plain call of an import's local name asks for."""
    return F.when(_named(i), i["symbol"]).when(i["is_default"], F.coalesce(i["alias"], i["symbol"]))


def _renamed(i: Column) -> Column:
    return i["alias"].isNotNull() & _named(i) & (i["alias"] != i["symbol"])


def _context(files: DataFrame, chunks: DataFrame, lone: DataFrame, imports: Column) -> DataFrame:
    """``file_id, __context``: a file's own unique symbols, those of the files that its sources may mean, and what renamed symbols are anywhere."""
    none = F.lit(None).cast("string")
    sources = F.transform(F.array_distinct(F.transform("__imports", lambda i: i["source"])), lambda x: F.struct(x.alias("source"), none.alias("desired")))
    renamed = F.transform(F.array_distinct(F.transform(F.filter("__imports", _renamed), lambda i: i["symbol"])), lambda x: F.struct(none.alias("source"), x.alias("desired")))
    each = files.select("file_id", "path", P.stored_language(F.col("lang"), F.col("path")).alias("lang"), imports.alias("__imports"))
    each = each.select("file_id", "path", "lang", F.explode(F.concat(sources, renamed)).alias("__one")).select("file_id", "path", "lang", "__one.*")
    keys = F.when(F.col("desired").isNull(), import_paths(F.col("path"), F.col("lang"), F.col("source"))).otherwise(F.array("desired"))
    each = each.select("file_id", "source", F.col("desired").isNull().alias("__path"), F.posexplode(keys).alias("at", "__key"))
    own = unique_symbols_in_file(chunks)
    exports = own.select("file_id", F.lit(_BY_NAME).alias("step"), "symbol", "chunk_id").unionByName(only_functions(chunks).select("file_id", F.lit(_BY_DEFAULT).alias("step"), F.lit(None).cast("string").alias("symbol"), "chunk_id"))
    placed = files.select("file_id", F.lit(True).alias("__path"), F.col("path").alias("__key")).join(exports, "file_id").drop("file_id")
    late = lone.select(F.lit(False).alias("__path"), F.col("symbol").alias("__key"), F.lit(_LATE).alias("step"), "symbol", "chunk_id")
    met = each.join(placed.unionByName(late), ["__path", "__key"])
    met = met.select("file_id", "step", "source", F.when(F.col("__path"), F.col("at")).otherwise(1 << 30).alias("at"), "symbol", "chunk_id")
    met = met.unionByName(own.select("file_id", F.lit(_OWN).alias("step"), none.alias("source"), F.lit(0).alias("at"), "symbol", "chunk_id"))
    return met.groupBy("file_id").agg(F.collect_list(F.struct("step", "source", "at", "symbol", "chunk_id")).alias("__context"))


def _scope(context: Column, imports: Column) -> Column:
    """Names to ``chunk_id, late``: own symbols, else the first success along the imports; late: an earlier import of the name may succeed anywhere."""
    own = F.transform(F.filter(context, lambda e: e["step"] == _OWN), lambda e: F.struct(e["symbol"].alias("name"), F.struct(e["chunk_id"].alias("chunk_id"), F.lit(False).alias("late")).alias("to")))
    local = lambda i: F.coalesce(i["alias"], i["symbol"])

    def met(e: Column, i: Column) -> Column:
        by_name = (_desired(i) == e["symbol"]) & (i["source"] == e["source"])
        by_default = i["is_default"] & i["symbol"].isNull() & (i["source"] == e["source"])
        return F.when(e["step"] == _BY_NAME, by_name).when(e["step"] == _BY_DEFAULT, by_default).otherwise(_renamed(i) & (i["symbol"] == e["symbol"]))

    hits = lambda e: F.transform(F.filter(imports, lambda i: met(e, i) & local(i).isNotNull()), lambda i: F.struct(local(i).alias("local"), i["ord"].alias("imp"), e["at"].alias("at"), e["step"].alias("step"), e["chunk_id"].alias("chunk_id")))
    ranked = F.array_sort(F.flatten(F.transform(F.filter(context, lambda e: e["step"] != _OWN), hits)))
    first = F.filter(ranked, lambda h, n: (n == 0) | (F.get(ranked, n - 1)["local"] != h["local"]))
    free = F.filter(first, lambda h: ~F.exists(context, lambda e: (e["step"] == _OWN) & (e["symbol"] == h["local"])))
    before = lambda h: F.exists(imports, lambda i: (local(i) == h["local"]) & (_desired(i) == h["local"]) & (i["ord"] < h["imp"]))
    via = F.transform(free, lambda h: F.struct(h["local"].alias("name"), F.struct(h["chunk_id"].alias("chunk_id"), before(h).alias("late")).alias("to")))
    return F.map_from_entries(F.concat(own, via))


def resolve_plain(files: DataFrame, chunks: DataFrame, lone: DataFrame, imports: Column, names: Column, calls: Callable[..., DataFrame], most: int = BROADCAST_BYTES) -> DataFrame:
    """What ``resolve`` finds for calls without receivers, where a row of ``files`` holds what its imports and calls are made from.

    ``imports`` and ``names`` make a file's imports and the names it calls from its row; ``calls(files, *kept)`` makes its calls,
    with ``callee_name`` and the columns to keep.  What names stand for is gathered by file and meets the files' rows once:
    neither calls nor imports travel.  ``lone``: the project's unique symbols, read several times.  A row gives its calls once,
    whatever its id.
    """
    context = _context(files, chunks, lone, imports)
    keyed = files.withColumn("__key", F.coalesce("file_id", F.xxhash64(names)))  # rows without an id are dealt out by what they call
    scoped = keyed.join(context.withColumnRenamed("file_id", "__key"), "__key", "left")
    few = (lone.agg(F.sum(F.octet_length("symbol") + 64)).first()[0] or 0) <= most
    if not few:  # a name of a file at most once, by shuffle; what a name is anywhere holds for all rows of a key
        called = keyed.select("__key", F.explode(F.array_distinct(names)).alias("symbol")).join(lone.hint("merge"), "symbol")
        scoped = scoped.join(called.groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("symbol", "chunk_id"))).alias("__lone")), "__key", "left")
    mine = F.when(F.col("file_id").isNotNull(), F.col("__context"))
    scoped = scoped.withColumn("__context", F.coalesce(mine, F.array().cast(context.schema["__context"].dataType))).withColumn("__imports", imports)
    scoped = scoped.withColumn("__scope", _scope(F.col("__context"), F.col("__imports"))).drop("__context", "__imports")
    if few:
        found = calls(scoped, "__scope").join(F.broadcast(lone.select(F.col("symbol").alias("callee_name"), F.col("chunk_id").alias("__anywhere"))), "callee_name", "left")
    else:
        found = calls(scoped, "__scope", "__lone").withColumn("__anywhere", F.try_element_at("__lone", F.col("callee_name"))).drop("__lone")
    found = found.withColumn("__to", F.try_element_at("__scope", F.col("callee_name")))
    anywhere = F.col("__to").isNull() | (F.col("__to.late") & F.col("__anywhere").isNotNull())
    return found.withColumn("resolved_chunk_id", F.when(anywhere, F.col("__anywhere")).otherwise(F.col("__to.chunk_id"))).drop("__scope", "__anywhere", "__to")


def _java(package: Column) -> Column:
    out = F.lit(False)
    for p in R.JAVA_PACKAGES:
        out = out | (package == p) | package.startswith(p + ".")
    return out


def import_kinds(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, local, import_kind``: what a bound name stands for, by all imports that bind it."""
    placed = local_imports(imports).join(files.select("file_id", "path", P.stored_language(F.col("lang"), F.col("path")).alias("lang")), "file_id")
    source, lang = F.col("source"), F.col("lang")
    candidates = F.when(lang == "python", import_paths(F.col("path"), lang, source)).otherwise(F.array().cast("array<string>"))
    every = files.select(F.col("path").alias("__there"))
    exploded = placed.select("file_id", "local", "source", F.explode(candidates).alias("__there"))
    known = exploded.join(every, "__there", "left_semi").select("file_id", "local", "source").distinct().withColumn("__project", F.lit(True))
    rows = placed.join(known, ["file_id", "local", "source"], "left")
    first = lambda sep: F.trim(F.substring_index(source, sep, 1))
    trimmed = F.trim(source)
    kind = (
        F.when(source == "", None)
        .when(lang == "python", F.when(source.startswith(".") | F.col("__project"), PROJECT).when(first(".").isin(*R.PYTHON_MODULES), STDLIB).otherwise(EXTERNAL))
        .when(
            lang.isin(*P.JAVASCRIPT),
            F.when(trimmed.startswith("./") | trimmed.startswith("../") | trimmed.startswith("/"), PROJECT)
            .when(F.regexp_replace(source, "^node:", "").isin(*R.NODE_MODULES), STDLIB)
            .otherwise(EXTERNAL),
        )
        .when(lang == "go", F.when((source == "C") | F.contains(first("/"), F.lit(".")), EXTERNAL).otherwise(STDLIB))
        .when(lang == "java", F.when(_java(trimmed), STDLIB).otherwise(EXTERNAL))
        .when(lang == "rust", F.when(first("::").isin("crate", "self", "super"), PROJECT).when(first("::").isin(*R.RUST_CRATES), STDLIB).otherwise(EXTERNAL))
    )
    weight = F.when(kind == PROJECT, 3).when(kind == STDLIB, 2).when(kind == EXTERNAL, 1).otherwise(0)
    spoken = rows.where(lang.isin(*P.JAVASCRIPT, "python", "go", "java", "rust"))
    ranked = spoken.groupBy("file_id", "local").agg(F.max(weight).alias("w"))
    names = F.when(F.col("w") == 3, PROJECT).when(F.col("w") == 2, STDLIB).when(F.col("w") == 1, EXTERNAL).otherwise(UNRESOLVED)
    return ranked.select("file_id", "local", names.alias("import_kind"))


def own_kind(lang: Column, callee: Column, is_method: Column, receiver: Column, std_header: Column) -> Column:
    """The kind of an unresolved call without an import, by the rules of its language."""
    lead, plain = leading_identifier(receiver), ~is_method
    root = F.trim(F.substring_index(F.trim(receiver), "::", 1))
    yes = lambda c: F.coalesce(c, F.lit(False))
    libc = callee.isin(*R.C_FUNCTIONS)
    return (
        F.when(lang == "python", F.when(callee.isin(*R.PYTHON_BUILTINS) & (plain | yes(lead == "builtins")), BUILTIN))
        .when(lang.isin(*P.JAVASCRIPT), F.when(yes(lead.isin(*R.JS_OBJECTS)) | (plain & callee.isin(*R.JS_FUNCTIONS)), BUILTIN))
        .when(lang == "go", F.when(plain & callee.isin(*R.GO_BUILTINS), BUILTIN))
        .when(lang == "java", F.when(yes(_java(F.trim(receiver)) | lead.isin(*R.JAVA_CLASSES)), STDLIB))
        .when(lang == "rust", F.when(yes(root.isin(*R.RUST_CRATES)) | (plain & callee.isin(*R.RUST_FUNCTIONS)), STDLIB))
        .when(lang == "c", F.when(libc, STDLIB))
        .when(lang == "cpp", F.when(yes(root == "std") | libc | (std_header & callee.isin(*R.CPP_FUNCTIONS)), STDLIB))
    )


def classify(calls: DataFrame, files: DataFrame, chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """Resolved ``calls`` with ``target_kind``."""
    where = chunks.select(F.col("chunk_id").alias("caller_chunk_id"), "file_id")
    paths = files.select("file_id", P.stored_language(F.col("lang"), F.col("path")).alias("lang"))
    headers = imports.where(F.trim("source").isin(*R.C_HEADERS)).select("file_id").distinct().withColumn("std_header", F.lit(True))
    kinds = import_kinds(imports, files)
    named = lambda n: kinds.select("file_id", F.col("local").alias(f"l{n}"), F.col("import_kind").alias(f"k{n}"))
    out = calls.join(where, "caller_chunk_id").join(paths, "file_id").join(headers, "file_id", "left")
    out = out.withColumn("l1", F.trim("receiver")).withColumn("l2", leading_identifier(F.col("receiver"))).withColumn("l3", F.col("callee_name"))
    for n in (1, 2, 3):
        out = out.join(named(n), ["file_id", f"l{n}"], "left")
    own = own_kind(F.col("lang"), F.col("callee_name"), F.col("is_method"), F.col("receiver"), F.coalesce("std_header", F.lit(False)))
    kind = F.when(F.col("resolved_chunk_id").isNotNull(), PROJECT).otherwise(F.coalesce("k1", "k2", "k3", own, F.lit(UNRESOLVED)))
    return out.select(*calls.columns, kind.alias("target_kind"))


def call_details(calls: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``calls`` with the caller's chunk, symbol and file."""
    caller = chunks.select(F.col("chunk_id").alias("caller_chunk_id"), F.col("symbol").alias("caller_symbol"), "file_id")
    return calls.join(caller, "caller_chunk_id").join(files.select("file_id", F.col("path").alias("caller_file")), "file_id")


def _caller_rows(found: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    at = (F.col("line").alias("call_line"), F.col("column").alias("call_column"))
    rows = call_details(found, files, chunks).select("caller_chunk_id", "caller_symbol", "caller_file", *at, "callee_name", "is_method", "receiver")
    return rows.orderBy("caller_file", "call_line", "call_column")


def callers(symbol: str, calls: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Calls resolved to the chunks of that symbol; if no chunk bears it, calls by that name."""
    targets = chunks.where(F.col("symbol") == symbol).select(F.col("chunk_id").alias("resolved_chunk_id"))
    known = targets.limit(1).agg((F.count("*") > 0).alias("__known"))
    hits = calls.join(targets.withColumn("__hit", F.lit(True)), "resolved_chunk_id", "left").join(F.broadcast(known))
    found = hits.where(F.when(F.col("__known"), F.coalesce("__hit", F.lit(False))).otherwise(F.col("callee_name") == symbol))
    return _caller_rows(found, files, chunks)


class NotFound(LookupError):
    """No chunk bears the symbol."""


class Ambiguous(LookupError):
    """Several chunks bear the symbol; the message lists some."""


def callers_in_file(symbol: str, path: str, calls: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Calls resolved to that file's chunks of the symbol."""
    here = files.where(F.col("path") == path).select("file_id")
    targets = chunks.where(F.col("symbol") == symbol).join(here, "file_id", "left_semi").select(F.col("chunk_id").alias("resolved_chunk_id"))
    if targets.isEmpty():
        raise NotFound(f"symbol not found: {symbol} in {path}")
    found = calls.join(targets, "resolved_chunk_id", "left_semi")
    return _caller_rows(found, files, chunks)


def root_chunk(symbol: str, files: DataFrame, chunks: DataFrame, path: str | None = None) -> int:
    """The one chunk of a symbol (in a file)."""
    found = chunks.where(F.col("symbol") == symbol).join(files.select("file_id", "path"), "file_id")
    found = found.where(F.col("path") == path) if path is not None else found
    rows = found.orderBy("path", "start_line").select("chunk_id", "path", "start_line").limit(6).collect()
    if not rows:
        raise NotFound(f"symbol not found: {symbol}")
    if len(rows) > 1:
        raise Ambiguous(f"ambiguous symbol: {symbol}; use --file: " + ", ".join(f"{r['path']}:{r['start_line']}" for r in rows))
    return rows[0]["chunk_id"]


def callees(calls: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Classified calls with what they resolve to: symbol, file and line of the target."""
    target = chunks.select(F.col("chunk_id").alias("resolved_chunk_id"), F.col("symbol").alias("resolved_symbol"), F.col("file_id").alias("__file"), F.col("start_line").alias("resolved_line"))
    places = files.select(F.col("file_id").alias("__file"), F.col("path").alias("resolved_file"))
    return calls.join(target, "resolved_chunk_id", "left").join(places, "__file", "left").drop("__file")
