"""Line-window chunks: the fallback for text without a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

WINDOW, OVERLAP = 500, 50


def line_windows(df: DataFrame, text: str = "content", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without ``text``, a row per window: ``symbol, kind, start_line, end_line, content``.

    Up to ``size`` lines make one chunk; longer texts get windows that share ``overlap`` lines, the last ending
    with the text.  A text without lines gives one chunk 1..0.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    n = F.size("__lines")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    rest = [c for c in df.columns if c != text]
    at = df.withColumn("__lines", T.lines(F.col(text))).withColumn("__start", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)))
    end = F.least(F.col("__start") + size, n)
    body = F.array_join(F.slice("__lines", F.col("__start") + 1, F.greatest(end - F.col("__start"), F.lit(0))), "\n")
    return at.select(
        *rest, F.lit(None).cast("string").alias("symbol"), F.lit("block").alias("kind"), (F.col("__start") + 1).alias("start_line"),
        end.alias("end_line"), T.normalize_content(body).alias("content"),
    )
