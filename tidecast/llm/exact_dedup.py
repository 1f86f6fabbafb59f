"""Exact deduplication by a distributed content sort, with DataFrame operations only.

1. A bounded sample gives splitters, and ``repartitionByRange`` deals the rows by the normalised head of the text, its
   length, a hash of the whole and a salt. Splitters hold heads, never whole texts, so that the driver's sample stays small.
2. Within a partition an external sort on head, length, hash, salt, whole normalised text and identifier puts equal texts
   next to each other; the window operator compares each row's whole text with its neighbour's to find where a run ends.
3. Texts of more rows than an eighth of a partition's share go through the sort by themselves, their copies dealt by a salt
   to as many pieces as hold such a share each, so that no group of copies meets in one task. The first row of each piece
   goes through the same comparison of neighbours once more, which merges the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import ascii_lower, cut, parts

HEAD = 64
#: A text of fewer copies than this is never split.
FEW = 100


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256 (+ ``text_col`` and the columns ``carry``).

    Texts are equal when identical after lower-casing A-Z. ``keep`` says which identifier of a group stays, ``largest``
    or ``smallest``. Null texts count as empty texts; all such rows are one group. A null identifier loses against any
    other; a group of nothing else keeps one row, with a null keep_id. Of repeated rows (same identifier and text) one is
    kept. An empty table gives an empty result. Other columns are ignored; a column to carry must not have the name of one
    that is made. Texts may be of any length; they are moved once, and those of split groups twice.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    if clash := {id_col, "keep_id", "group_size", "kept", "text_sha256"} & {text_col, *carry}:
        raise ValueError(f"columns to carry have names of the result: {sorted(clash)}")
    best = F.max if keep == "largest" else F.min
    first = lambda c: F.col(c).desc_nulls_last() if keep == "largest" else F.col(c).asc_nulls_last()
    extra = [F.struct(*(F.col(c) for c in dict.fromkeys((text_col, *carry)))).alias("extra")] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *extra).select(
        "id", "text", *["extra"] * len(extra), ascii_lower(F.substring("text", 1, HEAD)).alias("head"), F.octet_length("text").alias("len"), F.xxhash64(F.lower("text")).alias("hash")
    )
    # The hash is of the text in lower case as such: coarser than the normal form, and faster.
    share = docs.count() // (8 * parts(docs.sparkSession)) + FEW
    # At most 8 texts per partition have more copies than that, and their pieces are at most twice as many.
    crowds = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("hash", F.ceil(F.col("n") / share).alias("pieces"))
    crowds = cut(crowds)
    more = ["extra"] * len(extra)

    def sorted_runs(rows: DataFrame, *salt: str) -> DataFrame:
        """The content sort: of each row the best identifier and the size of its run, and whether it leads it."""
        dealt = rows.repartitionByRange("head", "len", "hash", *salt).withColumn("norm", ascii_lower(F.col("text")))
        run = Window.partitionBy("head", "len", "hash", *salt, "norm").orderBy(first("id"))
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dealt.select("id", *salt, "norm", F.sha2("norm", 256).alias("sha"), best("id").over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("n"), (F.row_number().over(run) == 1).alias("leads"), *more)

    if crowds.isEmpty():
        rest = rows
    else:
        rest = rows.join(F.broadcast(crowds), "hash", "left_anti")
    out = sorted_runs(rest).select("id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("leads").alias("kept"), "sha", *more)
    if not crowds.isEmpty():
        salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), "pieces").alias("salt")
        split = sorted_runs(rows.join(F.broadcast(crowds), "hash").select(*rows.columns, salt), "salt")
        same = Window.partitionBy("norm").orderBy(first("best"), "salt")
        every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = cut(split.where("leads").select("sha", "salt", best("best").over(every).alias("keep_id"), F.sum("n").over(every).alias("group_size"), (F.row_number().over(same) == 1).alias("first_piece")))
        # The first row of the first piece leads the whole group. A row per piece: at most 16 times the partitions.
        again = split.join(F.broadcast(merged), ["sha", "salt"]).select("id", "keep_id", "group_size", (F.col("leads") & F.col("first_piece")).alias("kept"), "sha", *more)
        out = out.unionByName(again)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *(F.col(f"extra.{c}") for c in dict.fromkeys((text_col, *carry)) if extra))
