"""Result formats: JSON lines, compact lines, graphs as DOT, text for people.

JSON and DOT lines are columns; only formatting for a terminal collects, and what it collects is a result already cut to k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RESULT = ["file", "symbol", "kind", "start", "end", "score"]


def _json(row: Column, nulls: bool) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false" if nulls else "true"})


def excerpt(snippet: Column, n: int) -> Column:
    """The first ``n`` lines, with ``...`` on its own line if there were more."""
    if n < 1:
        raise ValueError("excerpt lines must be at least 1")
    parts = F.split(snippet, "\n", -1)
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), "\n"), F.lit("\n..."))).otherwise(snippet)


def results_jsonl(results: DataFrame, excerpt_lines: int | None = None) -> DataFrame:
    """``rank, line``: every field; a null symbol is kept, a missing chunk id is left out."""
    snippet = F.col("snippet") if excerpt_lines is None else excerpt(F.col("snippet"), excerpt_lines)
    shown = results.withColumn("snippet", snippet)
    whole, bare = F.struct(*_RESULT, "snippet", "chunk_id"), F.struct(*_RESULT, "snippet")
    line = F.when(F.col("chunk_id").isNull(), _json(bare, True)).otherwise(_json(whole, True))
    return shown.select("rank", line.alias("line")).orderBy("rank")


def results_compact(results: DataFrame) -> DataFrame:
    return results.select("rank", _json(F.struct(*_RESULT), False).alias("line")).orderBy("rank")


def results_pretty(results: DataFrame, query: str, kind: str, lines: int = 8) -> str:
    rows = results.orderBy("rank").collect()
    out = [f"Query: {query}", f"Type: {kind}", f"Results: {len(rows)}", ""]
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r['score']:.3f} {r['file']}:{r['start']}-{r['end']} {r['symbol'] or '-'}")
        out += [f"    {x}" for x in r["snippet"].split("\n")[:lines]]
    return "\n".join(out)


def callers_jsonl(callers: DataFrame, compact: bool = False) -> DataFrame:
    name = F.concat_ws(".", "receiver", "callee_name")
    place = [F.col("caller_file").alias("file"), F.col("caller_symbol").alias("symbol"), F.col("call_line").alias("line"), F.col("call_column").alias("column")]
    row = F.struct(*place, name.alias("callee")) if compact else F.struct(*place, F.col("callee_name").alias("callee"), "is_method", "receiver")
    return callers.select("caller_file", "call_line", "call_column", _json(row, not compact).alias("line"))


def callees_jsonl(root: DataFrame, callees: DataFrame, compact: bool = False) -> DataFrame:
    """``ord, line``: the root (``symbol, file, line``) first, then its calls by place."""
    head = root.select(F.lit(0).alias("ord"), _json(F.struct(F.lit("root").alias("type"), "symbol", "file", "line"), True).alias("line"))
    name = F.concat_ws(".", "receiver", "callee_name")
    place = [F.col("resolved_symbol").alias("symbol"), F.col("resolved_file").alias("file"), F.col("resolved_line").alias("target_line"), F.col("target_kind").alias("kind")]
    if compact:
        row = F.struct(F.lit("callee").alias("type"), name.alias("callee"), F.col("line"), *place)
    else:
        row = F.struct(F.lit("callee").alias("type"), F.col("callee_name").alias("callee"), F.col("line"), "column", "is_method", "receiver", F.col("resolved_chunk_id").isNotNull().alias("resolved"), *place)
    order = Window.orderBy(F.col("line").asc_nulls_first(), F.col("column").asc_nulls_first(), "call_id")
    tail = callees.select(F.row_number().over(order).alias("ord"), _json(row, not compact).alias("line"))
    return head.unionByName(tail)


def graph_jsonl(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, a, b, line``: node rows, then edge rows."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit(0).alias("b"), _json(F.struct(F.lit("node").alias("type"), *nodes.columns), False).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("from").alias("a"), F.col("to").alias("b"), _json(F.struct(F.lit("edge").alias("type"), *edges.columns), False).alias("line"))
    return n.unionByName(e)


def _label(prefix: str) -> Column:
    file, line = F.col(f"{prefix}_file"), F.col(f"{prefix}_line").cast("string")
    place = F.when(file.isNotNull(), F.concat(F.lit("\\n"), F.concat_ws(":", file, line))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(F.col(f"{prefix}_symbol"), '"', '\\\\"'), place)


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    side = lambda p: nodes.select(F.col("id").alias(p), F.col("symbol").alias(f"{p}_symbol"), F.col("file").alias(f"{p}_file"), F.col("line").alias(f"{p}_line"))
    return edges.join(side("from"), "from").join(side("to"), "to")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``from, to, line``: an arrow per edge; nodes without an edge are not drawn."""
    line = F.concat(F.lit('  "'), _label("from"), F.lit('" -> "'), _label("to"), F.lit('";'))
    return labelled_edges(nodes, edges).select("from", "to", line.alias("line"))


def dot(nodes: DataFrame, edges: DataFrame) -> str:
    rows = dot_lines(nodes, edges).orderBy("from", "to").collect()
    return "\n".join(["digraph call_graph {", "  rankdir=LR;", "  node [shape=box];", *(r["line"] for r in rows), "}"])


def graph_compact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ord, line``: the root, then edges with both labels."""
    root = nodes.where("id = 1").select(F.lit(0).alias("ord"), _json(F.struct(F.lit("root").alias("type"), "symbol", "file", "line"), False).alias("line"))
    row = F.struct(F.lit("edge").alias("type"), F.col("from_symbol").alias("from"), F.col("to_symbol").alias("to"), "call_line", "call_column")
    return root.unionByName(labelled_edges(nodes, edges).select(F.col("from").alias("ord"), _json(row, False).alias("line")))


def graph_pretty(nodes: DataFrame, edges: DataFrame) -> str:
    rows = labelled_edges(nodes, edges).orderBy("from", "call_line", "call_column").collect()
    if not rows:
        return "\n".join(r["symbol"] for r in nodes.where("id = 1").collect())
    return "\n".join(f"{r['from_symbol']} -> {r['to_symbol']} (call {r['call_line']}:{r['call_column']})" for r in rows)
