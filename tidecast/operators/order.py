"""Row positions and rows before, of a table without keys, without one task that orders it all.

The rows are range-partitioned and sorted within partitions; a prefix scan over what each partition holds (its number of rows
and its last row, so many rows as there are partitions) gives the position that it starts at and the row before its first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.storage import written

PLACE = (1 << 33) - 1


def ranged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A table of the rows with _part, the range partition, and _at, the place in it from 0. Nulls come first."""
    # Rows of equal ``by`` may be very many; what else they hold deals them over several partitions, and settles their order.
    rest = F.xxhash64(*(f.name for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)))
    sorted_ = df.withColumn("_rest", rest).repartitionByRange(*by, "_rest").sortWithinPartitions(*by, "_rest").drop("_rest")
    placed = written(sorted_.withColumn("_id", F.monotonically_increasing_id()))  # partition and place, stored: they stay as they are
    return placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(PLACE)}).drop("_id")


def in_order(df: DataFrame, by: str | Sequence[str], position: str | None = "position", before: dict[str, str] | None = None) -> DataFrame:
    """The rows with their position in the order ``by`` (from 0), and columns of the row before: ``before`` is {new column: column}.

    Equal to row_number() - 1 and lag() over an ordered window of the whole table; the first row has nulls before it. Rows that
    are equal in ``by`` come in an order of their own, the same each time. The intermediate table stays in the shared folder, as
    the result reads it.
    """
    by, before = [by] if isinstance(by, str) else list(by), before or {}
    rows = ranged(df, by)
    last = F.max_by(F.struct(*(F.col(c).alias(n) for n, c in before.items())), "_at") if before else F.lit(None)
    ends = rows.groupBy("_part").agg((F.max("_at") + 1).alias("n"), last.alias("last")).collect()  # a row per partition
    start, carried, scan = 0, Row(**dict.fromkeys(before)) if before else None, []
    for part, n, final in sorted(ends, key=lambda r: r[0]):
        scan.append((part, start, *(carried or ())))
        start, carried = start + n, final
    kinds = [T.StructField(f"_carried_{n}", df.schema[c].dataType) for n, c in before.items()]
    of_part = df.sparkSession.createDataFrame(scan, T.StructType([T.StructField("_part", T.LongType()), T.StructField("_start", T.LongType()), *kinds]))
    out = rows.join(F.broadcast(of_part), "_part")  # a row per partition
    if position:
        out = out.withColumn(position, F.col("_start") + F.col("_at"))
    window = Window.partitionBy("_part").orderBy("_at")
    out = out.withColumns({n: F.when(F.col("_at") == 0, F.col(f"_carried_{n}")).otherwise(F.lag(c).over(window)) for n, c in before.items()}) if before else out
    return out.drop("_part", "_at", "_start", *(k.name for k in kinds))
