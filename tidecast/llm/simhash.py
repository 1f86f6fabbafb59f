"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance, as connected components.

Fingerprints are cut into DISTANCE + 2 segments, so that two linked ones agree on at least two of them; those with an equal
pair of segments meet, sorted, in a stream. Before the full Hamming check a pair has to pass the pigeonring filter: some
chain of consecutive segments, read around the ring, whose cumulative differences stay within the proportional budgets.
Equal fingerprints are one node from the start. Small groups are compared by offsets within the sorted stream; larger ones
are searched outwards from one member at a time, giving a spanning forest and not all pairs. A group beyond LARGEST members
is split in the same way as all fingerprints are: the bits that its key leaves open are cut into DISTANCE + 2 segments, and
those with an equal pair of these meet in a smaller group, as often as it takes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import cut, join_split, spans
from tidecast.llm.components import labelled

SEED = 42
SMALL, LARGEST = 16, 8192
#: Keys that leave so few bits open have groups of at most 2**OPEN different fingerprints and are not made longer.
OPEN = 13


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of the text's word shingles; zero for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts, ends = np.r_[0, ends[:-1] + 1][:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, 65_280):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + 65_280], ends[i : i + 65_280])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def segments(distance: int, bits: int = (1 << 64) - 1) -> list[int]:
    """Masks of distance + 2 segments of the given bits, as even as can be."""
    open_bits = [b for b in range(64) if bits >> b & 1]
    at = np.linspace(0, len(open_bits), distance + 3).round().astype(int).tolist()
    return [sum(1 << b for b in open_bits[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def longer_keys(keys: list[int], distance: int) -> list[tuple[int, int]]:
    """(number of the key's mask, mask) of each key mask and a pair of segments of the bits that it leaves open.

    Of those segments at most ``distance`` differ in two linked fingerprints, so that they agree on a pair at least.
    """
    return [(i, key | a | b) for i, key in enumerate(keys) for a, b in combinations(segments(distance, ~key & (1 << 64) - 1), 2)]


def ring(x: np.ndarray, masks: np.ndarray, distance: int, chain: int = 3) -> np.ndarray:
    """Which differences have a chain of segments with at most l * distance / m ones in its first l segments, for each l."""
    counts = np.stack([np.bitwise_count(x & m) for m in masks]).astype(np.int16)
    total, viable = np.zeros_like(counts), np.ones(counts.shape, bool)
    for l in range(1, chain + 1):  # noqa: E741
        total += np.roll(counts, 1 - l, axis=0)
        viable &= total * len(masks) <= l * distance
    return viable.any(axis=0)


def near(x: np.ndarray, masks: np.ndarray, distance: int) -> np.ndarray:
    """Indices of the differences of at most ``distance`` bits."""
    at = np.flatnonzero(ring(x, masks, distance))
    return at[np.bitwise_count(x[at]) <= distance]


def spanning(fp: np.ndarray, masks: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected by links among ``fp``."""
    left = fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            found = near(left ^ one, masks, distance)
            if len(found):
                yield np.full(len(found), one), left[found]
                front.extend(left[found])
                left = np.delete(left, found)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs a, b of the distinct fingerprints ``fp`` that connect what is connected within ``distance`` bits."""
    spark, masks = fps.sparkSession, np.array(segments(distance), np.uint64)
    signed = lambda m: m - (m >> 63 << 64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty((0, 2), np.int64), np.empty(0, np.uint64)

        def compare(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            size = np.diff(np.r_[starts, len(fp)])
            in_small = np.repeat((size > 1) & (size <= SMALL), size)
            group, some = np.repeat(np.arange(len(size)), size)[in_small], fp[in_small]
            for d in range(1, SMALL):
                at = np.flatnonzero(group[d:] == group[:-d])
                if not len(at):
                    break
                at = at[near(some[at] ^ some[at + d], masks, distance)]
                yield some[at], some[at + d]
            for s, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
                yield from spanning(fp[s : s + n], masks, distance)

        def out(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            a, b = zip(*found, strict=True) if (found := [f for f in found if len(f[0])]) else ((), ())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
            key, fp = np.concatenate([held_key, key]), np.concatenate([held, batch.column(2).to_numpy().view(np.uint64)])
            if not len(fp):
                continue
            last = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0
            yield from out(compare(key[:end], fp[:end]))
            held_key, held = key[end:], fp[end:]
        if len(held):
            yield from out(compare(held_key, held))

    keyed, keys, found = fps.select("fp", F.lit(0).alias("c")), [0], None
    while True:
        longer = longer_keys(keys, distance)
        keys = [m for _, m in longer]
        table = spark.createDataFrame([(c, i, signed(m)) for i, (c, m) in enumerate(longer)], "c int, i int, m long")
        keyed = keyed.join(F.broadcast(table), "c").select("fp", F.col("i").alias("c"), F.col("fp").bitwiseAND(F.col("m")).alias("v"))
        if min(64 - k.bit_count() for k in keys) <= OPEN:
            crowds = None
        else:
            crowds = cut(keyed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST).select("c", F.bitwise_not("v").alias("w")))
        some = crowds is not None and not crowds.isEmpty()
        keyed = keyed.withColumn("w", F.bitwise_not("v"))
        groups = keyed.join(crowds, ["c", "w"], "left_anti") if some else keyed
        runs = groups.repartition("c", "v").sortWithinPartitions("c", "v", "fp").select("c", "v", "fp").mapInArrow(run, "a long, b long")
        found = runs if found is None else found.unionByName(runs)
        if not some:
            return found
        keyed = cut(keyed.join(crowds, ["c", "w"], "left_semi").select("fp", "c"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 lowercase hex digits), component_id.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; shingles are ``words`` consecutive words joined by a space,
    repeats included, a shorter text being one shingle. A bit is set if it is set in over half of the shingles' XXH64 (seed
    42). Fingerprints within ``distance`` bits are linked, and component_id is the smallest identifier that links reach,
    itself included. Null texts, empty ones and such without words have fingerprint zero and are linked like any other. A
    null identifier is never smaller than another; a component of nothing else has a null component_id. Rows may repeat. An
    empty table gives an empty result. Other columns are ignored, whatever their names. Long texts are hashed in blocks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text"):
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long"))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    of_fp = labelled(nodes, "fp", "first", links(nodes.select("fp"), distance))
    return join_split(rows, of_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
