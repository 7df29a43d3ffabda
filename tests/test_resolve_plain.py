"""Calls without receivers, resolved from the files' rows: as ``resolve`` does, and without dealing out calls."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.operators import resolve

IMPORT = "struct<ord:int,source:string,symbol:string,alias:string,is_default:boolean>"


def exchanged(node):
    """Rows that the shuffles of a plan that has run wrote."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return exchanged(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return exchanged(node.plan())
    children = node.children()
    below = sum(exchanged(children.apply(i)) for i in range(children.size()))
    return below + (node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0)


def project(seed):
    """Files of few names, so that imports are renamed, repeated, defaults, stars, or lead nowhere."""
    r = random.Random(seed)
    names = [*"abcdefgh", "*", None]
    files, chunks = [], []
    for f in range(12):
        lang, path = r.choice([("python", f"m{f}.py"), ("typescript", f"m{f}.ts"), ("python", f"m{f}/__init__.py")])
        imports = [(r.randrange(4), (lang == "python" and f"m{r.randrange(13)}") or r.choice([f"./m{r.randrange(13)}", "", None]), r.choice(names), r.choice([None, None, *"abc"]), r.choice([None, False, True])) for _ in range(r.randrange(9))]
        # imports of one place and name would tie in their order
        imports = [(n, *i[1:]) for n, i in enumerate(sorted(imports, key=lambda i: i[0]))]
        files.append((f, path, lang, imports, [*"abcdefghz"]))
        chunks += [(f * 10 + n, f, r.choice([*"abcdefgh", "u" + str(f), None]), r.choice(["function", "class"]), 1) for n in range(r.randrange(4))]
    return files, chunks


@pytest.mark.parametrize("most", [resolve.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("seed", range(4))
def test_as_resolve(spark, seed, most):
    rows, chunks = project(seed)
    files = spark.createDataFrame(rows, f"file_id long, path string, lang string, imports array<{IMPORT}>, called array<string>")
    chunks = spark.createDataFrame(chunks, "chunk_id long, file_id long, symbol string, kind string, start_line int")
    calls = lambda d, *kept: d.select((F.col("file_id") * 100).alias("at"), *kept, F.posexplode("called").alias("n", "callee_name")).select((F.col("at") + F.col("n")).alias("call_id"), "callee_name", *kept)
    got = resolve.resolve_plain(files, chunks, resolve.unique_symbols(chunks), F.col("imports"), F.col("called"), calls, most)
    # resolve finds a call's file by its chunk: one more chunk without a symbol in each file
    callers = files.select((F.col("file_id") + 1000).alias("chunk_id"), "file_id", F.lit(None).cast("string").alias("symbol"), F.lit("class").alias("kind"), F.lit(1).alias("start_line"))
    flat = calls(files).select("call_id", (F.floor(F.col("call_id") / 100) + 1000).alias("caller_chunk_id"), "callee_name", F.lit(False).alias("is_method"), F.lit(None).cast("string").alias("receiver"))
    want = resolve.resolve(flat, files.select("file_id", "path", "lang"), chunks.unionByName(callers), files.select("file_id", F.inline("imports")))
    found = {r["call_id"]: r["resolved_chunk_id"] for r in got.collect()}
    assert len(found) == 108 and found == {r["call_id"]: r["resolved_chunk_id"] for r in want.collect()} and any(found.values())


def test_no_call_is_dealt_out(spark):
    out = entry.queries()["resolve_via_imports"](spark, "/root/testdata/sf0.001")
    n = len(out.collect())
    assert n > 50_000 and exchanged(out._jdf.queryExecution().executedPlan()) < n / 20


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return {(r["call_id"], r["resolved_chunk_id"]) for r in entry.queries()["resolve_via_imports"](spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("most", [resolve.BROADCAST_BYTES, 0])
def test_odd_documents(spark, tmp_path, monkeypatch, most):
    """Null, empty and blank texts, a document without a successor, and a word of its own, of the next and of one file."""
    monkeypatch.setattr(resolve, "resolve_plain", partial(resolve.resolve_plain, most=most))
    rows = [(1, "run the next stop", "en", "s", 0), (2, "the\nrun only", "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \n only", "en", "s", 0), (9, "the the", "en", "s", 0), (None, "x only", "en", "s", 0)]
    at = lambda doc, line, pos: (doc * 100000 + line) * 100000 + pos
    # "the" opens 2 and 9: document 1 has it of the next, 9 of itself; "only" opens 5 alone; a null id names no file
    assert write(spark, tmp_path, rows) == {(at(1, 1, 1), 2), (at(1, 1, 2), None), (at(1, 1, 3), None), (at(2, 2, 0), 1), (at(2, 2, 1), 5), (at(5, 2, 0), 5), (at(9, 1, 1), 9), (None, 5)}


def test_no_documents(spark, tmp_path):
    assert write(spark, tmp_path, []) == set()
