"""Small helpers of this subpackage: rows kept aside, digests, flattened batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """One struct column ``row`` of all columns, so that no name of theirs can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def digest128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under different seeds; NULL counts as absent, never as a NULL key."""
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else.

    ``lower`` is many times faster than ``translate`` and the same wherever no other
    character has a lower case, which one look at the characters beyond ASCII tells.
    """
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(beyond) == beyond, F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is empty. The bytes may be read-only."""
    column = column.fill_null("") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes; one longer text is one slice.

    Bounds what a task holds at once, whatever the length of the texts.
    """
    if not batch.num_rows:
        return
    _, offsets = flat_utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
