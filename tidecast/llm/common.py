"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.storage import cut, free, release, written

__all__ = ["ascii_lower", "cut", "free", "join_split", "maybe_in", "parts", "read", "release", "spans", "written"]

BITMAP = 1 << 24
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the only notion of cluster width that operators use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join on a long ``key`` with both sides dealt anew, which lets the adaptive planner split a key of very many rows.

    A side that an aggregate has already dealt by the key would be joined as it lies, and could not be split.
    """
    flipped = F.bitwise_not(key).alias("_flipped")
    return left.select("*", flipped).join(right.select(flipped, *(c for c in right.columns if c != key)), "_flipped", how).drop("_flipped")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a text of ASCII only by the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def spans(batches: Iterable[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of the string or binary ``column``; a longer value is a piece of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def maybe_in(df: DataFrame, key: str | list[str], ids: DataFrame, without: bool = False) -> DataFrame:
    """Rows whose ``key`` may be among those of ``ids``, without a shuffle of the rows; or those whose key surely is not.

    A filter before a join, never in its place: a bitmap of BITMAP bits by hash, that is at most BITMAP / 64 rows to
    broadcast whatever the size of ``ids``. With many more keys than bits it lets everything pass.
    """
    columns = [key] if isinstance(key, str) else key
    bit = F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(BITMAP))
    marks = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("_bitmap_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("_bitmap_marks"))
    seen = df.withColumn("_bitmap_bit", bit).withColumn("_bitmap_word", F.shiftright("_bitmap_bit", 6)).join(F.broadcast(marks), "_bitmap_word", "left")
    hit = F.coalesce(F.expr("(shiftright(_bitmap_marks, cast(_bitmap_bit & 63 as int)) & 1) = 1"), F.lit(False))
    return seen.where(~hit if without else hit).select(*df.columns)
