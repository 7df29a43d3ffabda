"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def content_hash(text: Column) -> Column:
    """XXH3-64 of the UTF-8 bytes, little-endian, as binary."""
    import pandas as pd
    import xxhash

    def digest(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else xxhash.xxh3_64_intdigest(bytes(x)).to_bytes(8, "little"))

    digest.__annotations__ = {"column": pd.Series, "return": pd.Series}  # as objects: the names are local
    return F.pandas_udf(digest, BinaryType())(text.cast("binary"))


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)
