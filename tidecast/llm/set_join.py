"""Similarity join of word shingles by a grouped prefix join (prefix filter: Chaudhuri et al., 2006; grouping: Bouros et al., 2012).

Two sets with a Jaccard similarity of s share all but a fraction 1 - s of the larger one, so that their first elements, in any
order that all sets have in common, meet. The order is by how often an element occurs, rare ones first; that is estimated from a
count sketch of all shingles (three rows of signed sums, the median counts), a table of one size whatever the corpus. Texts with
the same prefix and size are one group, and groups meet by the elements of their prefixes. What is left of a set after an
element bounds how many more it can share, and so the size that a partner may have: a pair of groups has to keep that bound
on both sides, which leaves out texts that share a common passage and are not similar for the rest.

The join goes in two rounds, as only the components of the links are asked for. In the first each group of a key meets the one
that has most of its set left there, and each member of a group its first one. The second round is complete: it forms the
remaining pairs, of groups and then of members, but only between texts that the first has not connected. So a large set of near
copies is connected by a number of comparisons in proportion to its size, and no pair of other texts is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.storage import forget, mark
from tidecast.llm.common import ascii_lower, cut, free, join_split, maybe_in, spans, written
from tidecast.llm.components import connected_components, labelled
from tidecast.llm.words import mixed, shingle_sets

#: The count sketch: rows, slots of a row, slots that travel together.
ROWS, SLOTS, CHUNK = 3, 1 << 20, 1 << 16
SPAN = 2_000_000


def slots(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of the sketch the elements' slots and signs, from bits of their own."""
    for r in range(ROWS):
        yield (h >> np.uint64(20 * r) & np.uint64(SLOTS - 1)).astype(np.int64), 1 - 2 * (h >> np.uint64(60 + r) & np.uint64(1)).astype(np.int64)


def levels(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How common elements are by the sketch's ``table`` of signed logarithms; zero for rare ones."""
    return np.maximum(np.median(np.stack([sign * table[r][slot] for r, (slot, sign) in enumerate(slots(h))]), axis=0), 0).astype(np.int64) if len(h) else np.empty(0, np.int64)


def reach(size: np.ndarray, left: np.ndarray, per_cent: int) -> np.ndarray:
    """The largest size of a partner that a set of ``size`` can have if they share ``left`` elements at most."""
    return (100 + per_cent) * left // per_cent - size


def least_size(size: np.ndarray, per_cent: int) -> np.ndarray:
    return -(-per_cent * size // 100)


def prefixes(own: np.ndarray, ends: np.ndarray, table: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of each set, by level and hash, and where those of each set begin (and the last end)."""
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    ordered = own[np.lexsort((own, levels(own, table), row))]
    many = np.where(size > 0, size - least_size(size, per_cent) + 1, 0)
    at = np.arange(len(own)) - np.repeat(ends[:-1], size)
    return ordered[at < np.repeat(many, size)], np.r_[0, np.cumsum(many)]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    return total[ends[1:]] - total[ends[:-1]]


def enough(both: int, left: int, right: int, per_cent: int) -> bool:
    return both > 0 and 100 * both >= per_cent * (left + right - both)


def numbered(own: np.ndarray) -> np.ndarray:
    """A sorted list in which equal values are told apart by their number, so that what two lists share is counted as often as both have it."""
    if own.dtype == np.uint64:
        return own
    return own.astype(np.int64) << 32 | np.arange(len(own)) - np.searchsorted(own, own)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, per_cent: int = 85, blank_linked: bool = False, hints: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; their sets are the different shingles of ``words`` consecutive
    words, a shorter text being one shingle. Texts link when 100 * intersection >= ``per_cent`` * union, and component_id is
    the smallest identifier that links reach, itself included. Texts without words, null ones too, have no shingles and are
    linked with nothing, or with each other if ``blank_linked``. A null identifier is never smaller than another; a component of
    nothing else has a null component_id. Rows may repeat. An empty table gives an empty result. Long texts are cut in numpy, one
    at a time, and compared whole. Texts and shingles are told apart by 64-bit hashes. Other columns are ignored, whatever their
    names. ``hints`` are further pairs a, b of hashes of lower-cased texts (xxhash64) that the first round compares; they don't change the result.
    """
    spark, since = docs.sparkSession, mark()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("s", F.xxhash64(ascii_lower(F.col("text"))))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text, and after them the partition's sketch in chunks."""
        total = np.zeros((ROWS, SLOTS), np.int64)
        names = ["id", "s", "size", "chunk", "counts"]
        for batch in spans(batches, "text", SPAN):
            own, ends = shingle_sets(batch.column(2), words)
            for r, (slot, sign) in enumerate(slots(own)):
                total[r] += np.bincount(slot, sign, SLOTS).astype(np.int64)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for c, part in enumerate(total.reshape(-1, min(CHUNK, SLOTS))):
            if part.any():
                packed = pa.compress(part.astype("<i8").tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch_id), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([packed])], names=names)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = min(CHUNK, SLOTS)
        for batch in batches:
            for c, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(packed, 8 * size, "zstd", asbytes=True), "<i8")
                held[c] = held[c] + part if c in held else part
        for c, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)])], names=["chunk", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    batch_id = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    first = written(source.select("id", "s", "text").mapInArrow(counted, f"id {kind}, s long, size long, chunk int, counts binary"))
    rows = cut(first.where("chunk IS NULL").select("id", F.when(F.lit(blank_linked) & (F.col("size") == 0), 0).otherwise(F.col("s")).alias("s"), "size"))
    table = np.zeros((ROWS, SLOTS), np.int64)
    for r in first.where("chunk IS NOT NULL").select("chunk", "counts").mapInArrow(added, "chunk int, counts binary").repartition("chunk").mapInArrow(added, "chunk int, counts binary").collect():  # ROWS * SLOTS numbers
        size = min(CHUNK, SLOTS)
        table.reshape(-1, size)[r["chunk"]] = np.frombuffer(pa.decompress(bytes(r["counts"]), 8 * size, "zstd", asbytes=True), "<i8")
    shared = spark.sparkContext.broadcast((np.sign(table) * np.round(2 * np.log2(1 + np.abs(table)))).astype(np.int8))

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text", SPAN):
            own, ends = shingle_sets(batch.column(1), words)
            some, at = prefixes(own, ends, shared.value, per_cent)
            size = np.diff(ends)
            group = mixed(sums(mixed(some), at) + mixed(size.astype(np.uint64)))
            data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((8 * at).astype(np.int64).tobytes()), pa.py_buffer(some.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group.view(np.int64)), pa.array(size), data.cast(pa.binary())], names=["s", "g", "size", "prefix"]).filter(pa.array(size > 0))

    def exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "prefix", SPAN):
            size = batch.column(1).to_numpy()
            many = size - least_size(size, per_cent) + 1
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            at = np.repeat(np.arange(len(size)), many)
            left = size[at] - (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0).take(pa.array(at)), pa.array(size[at]), pa.array(reach(size[at], left, per_cent))], names=["k", "g", "size", "most"])

    made = written(source.select("s", "text").mapInArrow(heads, "s long, g long, size long, prefix binary"))
    members = cut(made.select("g", "s").distinct())
    # A group's prefix is read from one of its rows; only rows of groups that have several are shuffled for that.
    several = cut(made.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    own = made.select("g", "size", "prefix")
    groups = maybe_in(own, "g", several, without=True).unionByName(maybe_in(own, "g", several).dropDuplicates(["g"])).mapInArrow(exploded, "k long, g long, size long, most long")
    # A key counts if two groups have it of which the smaller may find the other.
    keys = groups.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("smallest"), F.max("most").alias("widest"), F.max(F.expr("most >= size")).alias("open")).where("n > 1 AND open").select("k", "smallest", "widest")
    keys = cut(keys)
    crowd = written(join_split(maybe_in(groups, "k", keys), keys, "k").where("most >= smallest AND size <= widest").select("k", "g", "size", "most"))
    free(spark)  # here and below: what has been joined and grouped up to now would else stay on disk to the end
    may = "{a}most >= {b}size AND {b}most >= {a}size"

    def sets_of(short: bool):  # noqa: ANN202
        """Each text's set: whole, or the first 16 bits of each hash, which may only have more in common."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in spans(batches, "text", SPAN):
                own, ends = shingle_sets(batch.column(1), words)
                own = (own >> np.uint64(48)).astype(np.uint16) if short else own
                data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((own.itemsize * ends).astype(np.int64).tobytes()), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), data.cast(pa.binary())], names=["s", "own"])

        return run

    def compared(pairs: DataFrame, short: bool) -> DataFrame:
        """Of the pairs, which are a checkpoint, those that link; with short sets those that may."""
        free(spark)
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct())
        texts = maybe_in(source.select("s", "text"), "s", wanted).join(wanted, "s", "left_semi").dropDuplicates(["s"])
        own = written(texts.mapInArrow(sets_of(short), "s long, own binary"))
        kind = np.uint16 if short else np.uint64

        def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in spans(batches, "left", SPAN):
                good = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    left, right = (numbered(np.frombuffer(v.as_buffer(), kind)) for v in (x, y))
                    good.append(enough(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), per_cent))
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

        left, right = own.withColumnRenamed("own", "left"), own.withColumnRenamed("own", "right")
        half = join_split(pairs.withColumnRenamed("a", "s"), left, "s").withColumnRenamed("s", "a").withColumnRenamed("b", "s")
        return cut(join_split(half, right, "s").select("a", F.col("s").alias("b"), "left", "right").mapInArrow(verify, "a long, b long"))

    def verified(pairs: DataFrame) -> DataFrame:
        return compared(compared(pairs, True), False)

    ordered = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    one = cut(members.groupBy("g").agg(F.min("s").alias("one"), F.count(F.lit(1)).alias("n")))
    centre = crowd.groupBy("k").agg(F.max(F.struct((F.col("most") / F.col("size")).alias("share"), F.col("g").alias("c_g"), F.col("size").alias("c_size"), F.col("most").alias("c_most"))).alias("c")).select("k", "c.c_g", "c.c_size", "c.c_most")
    met = join_split(crowd, centre, "k").where(may.format(a="", b="c_")).where("g <> c_g").select("g", "c_g").distinct()
    met = met.join(one.select("g", F.col("one").alias("x")), "g").join(one.select(F.col("g").alias("c_g"), F.col("one").alias("y")), "c_g")
    inside = join_split(members, one.where("n > 1"), "g").where("s <> one")
    near = ordered(met, "x", "y").unionByName(ordered(inside, "s", "one"))
    if hints is not None:
        near = near.unionByName(ordered(hints, "a", "b"))
    links = verified(cut(near.distinct()))
    roots = cut(connected_components(links))

    # The second round: what has different roots. A group whose members have several is a root of its own here.
    rooted = cut(join_split(members, roots.withColumnRenamed("node", "s"), "s", "left").select("g", "s", F.coalesce("root", "s").alias("root")))
    of_group = rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).select("g", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("g")).alias("root"), (F.col("low") != F.col("high")).alias("mixed"))
    of_group = cut(of_group)
    left = join_split(crowd, of_group.select("g", "root"), "g")
    several = cut(left.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k"))
    left = written(join_split(maybe_in(left, "k", several), several, "k"))
    parts = left.groupBy("k", "root").agg(F.min("size").alias("least"), F.max("size").alias("size"), F.max("most").alias("most"))
    parts = cut(parts)
    side = lambda x: parts.select("k", *(F.col(c).alias(f"{x}{c}") for c in ("root", "least", "size", "most")))
    far = join_split(side("a_"), side("b_"), "k").where("a_root < b_root AND a_most >= b_least AND b_most >= a_least").select("k", "a_root", "b_root", F.col("b_least").alias("smallest"), F.col("b_most").alias("widest"))
    far = cut(far)
    free(spark)
    every = lambda x: left.select(F.xxhash64("k", "root").alias("h"), *(F.col(c).alias(f"{x}{c}") for c in ("k", "root", "g", "size", "most")))
    pairs = far.select(F.xxhash64("k", "a_root").alias("h"), "k", "a_root", "b_root", "smallest", "widest")
    pairs = join_split(pairs, every("a_").withColumnRenamed("a_root", "r"), "h").where("k = a_k AND r = a_root AND a_most >= smallest AND widest >= a_size").select(F.xxhash64("k", "b_root").alias("h"), "k", "b_root", "a_g", "a_size", "a_most")
    pairs = join_split(pairs, every("b_").withColumnRenamed("b_root", "r"), "h").where("k = b_k AND r = b_root").where(may.format(a="a_", b="b_"))
    pairs = cut(ordered(pairs, "a_g", "b_g").distinct())
    of = lambda x: rooted.select(*(F.col(c).alias(f"{x}{c}") for c in ("g", "s", "root")))
    both = join_split(join_split(pairs.withColumnRenamed("a", "a_g"), of("a_"), "a_g").withColumnRenamed("b", "b_g"), of("b_"), "b_g").where("a_root <> b_root")
    own = of_group.where("mixed").select("g")
    own = join_split(join_split(of("a_").withColumnRenamed("a_g", "g"), own, "g"), of("b_").withColumnRenamed("b_g", "g"), "g").where("a_s < b_s AND a_root <> b_root")
    links = links.unionByName(verified(cut(ordered(both, "a_s", "b_s").unionByName(ordered(own, "a_s", "b_s")).distinct())))
    nodes = rows.groupBy("s").agg(F.min("id").alias("first"))
    of_text = cut(labelled(nodes, "s", "first", links))
    forget(spark, since)
    component = F.col("component_id") if blank_linked else F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id"))
    return join_split(rows, of_text, "s").select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))
