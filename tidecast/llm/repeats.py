"""Removal of word runs that an earlier document has too: seeds by winnowed anchors, matches extended both ways.

Every window of WINDOW words picks one of its ANCHOR-word hashes, the least, by its own content alone (winnowing). Windows in
a row that pick the same anchor form a stretch: the words around the anchor as far as it rules. Equal text gives equal
anchors and, but for the ends of the common run, equal stretches; so

1. anchors of one identifier only are dropped,
2. of equal stretches (by 128 bits: anchor and stretch) all but those of the first document go as a whole, which leaves one
   representative of each different stretch, and
3. where a shared anchor has different stretches, their windows are seeds: a representative is joined with the first
   holder of any of its windows, the words of both are compared and the match extended from the seed to the left and to the
   right; the maximal repeat, if it has WINDOW words or more, goes.

Minima are aggregated with map-side combining and joined back; no group of documents is gathered and no pairs within a group
are made: a representative meets one holder per window at most. Texts are moved only for documents that have such stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import cut, maybe_in, spans, written

WINDOW, ANCHOR = 50, 10
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 22
LAST = 2**63 - 1
#: What tells rows apart: the identifier and 128 bits of the text. Rows equal in these are equal, and so is their result.
KEY = ["did", "k1", "k2"]


class Hasher:
    """Hashes of word runs; words' own hashes are kept in a bounded table."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most
        self.powers = self.inverse = np.ones(1, np.uint64)

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def prefix(self, h: np.ndarray) -> np.ndarray:
        """Sums of word hashes times powers of an odd base, modulo 2**64."""
        n = len(h)
        if len(self.powers) < n + 1:
            size = 1 << int(n + 1).bit_length()
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)])
        return np.r_[np.uint64(0), np.cumsum(h * self.powers[:n])]

    def runs(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Mixed hashes of the runs of words; the length is part of them."""
        x = (prefix[start + length] - prefix[start]) * self.inverse[start] + np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, from running minima within blocks of that width."""
    n = len(key)
    padded = np.r_[key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(hasher: Hasher, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, stretch hash, first window, windows) arrays of a document's blocks."""
    windows, width = len(prefix) - WINDOW, WINDOW - ANCHOR + 1
    for at in range(0, windows, BLOCK):
        n = min(BLOCK, windows - at)
        grams = hasher.runs(prefix, np.arange(at, at + n + width - 1), ANCHOR)
        place = np.uint64((1 << 23) - 1)
        chosen = (least_in_windows(grams & ~place | np.arange(len(grams), dtype=np.uint64), width) & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        count = np.diff(np.r_[first, n])
        offset = (chosen[first] - first).astype(np.uint64)
        whole = hasher.runs(prefix, at + first, count + WINDOW - 1) + offset
        yield grams[chosen[first]], whole, at + first, count


def spot(first: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """A run of words as one number: its first word and how many (at most 2 WINDOW - ANCHOR)."""
    return first << 7 | words


def extended(left: list[bytes], right: list[bytes], i: int, j: int) -> tuple[int, int]:
    """(first word in ``left``, words) of the maximal repeat through the windows at i and j; no words if these differ."""
    if left[i : i + WINDOW] != right[j : j + WINDOW]:
        return i, 0
    lo, hi = 0, WINDOW
    while lo < min(i, j) and left[i - lo - 1] == right[j - lo - 1]:
        lo += 1
    while hi < min(len(left) - i, len(right) - j) and left[i + hi] == right[j + hi]:
        hi += 1
    return i - lo, lo + hi


def runs_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, kept_sha256 (+ kept_text) (+ the columns ``carry``).

    Words are cut at ASCII white space and compared as they are. A word goes if it is in a run of 50 consecutive words which
    also starts in a document with a smaller identifier; runs are judged on the input. kept_sha256 is of the kept words
    joined by a space; kept_text is these too, but the text as it is (or null) where nothing goes. Null texts have no words.
    A null identifier counts as larger than any other. Rows that share an identifier are no earlier than one another, so that
    repeated rows have the same result. An empty table gives an empty result. Extra columns are ignored; a column to carry
    must not have the name of one that is made. Texts may be of any length: one is worked on in blocks of windows.
    """
    if clash := {id_col, "n_words", "n_removed", "kept_sha256", "kept_text"} & set(carry):
        raise ValueError(f"columns to carry have names of the result: {sorted(clash)}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    source = docs.select(*key, text.alias("text"))
    longs = lambda *names: ", ".join(f"{n} long" for n in names)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in spans(batches, "text"):
            out: list[tuple] = []
            for row, text in enumerate(batch.column(3)):
                prefix = hasher.prefix(hasher.words(text.as_py().encode().split()))
                if len(prefix) > WINDOW:
                    out += [(row, spot(first, count + WINDOW - 1), anchor.view(np.int64), whole.view(np.int64)) for anchor, whole, first, count in stretches(hasher, prefix)]
            if out:
                rows, *lists = zip(*out, strict=True)
                own = [batch.column(i).take(pa.array(rows)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=[*KEY, "spot", "anchor", "whole"])

    found = cut(source.mapInArrow(find, f"{longs(*KEY)}, spot array<long>, anchor array<long>, whole array<long>"))
    found = found.select(*KEY, F.explode(F.arrays_zip("spot", "anchor", "whole")).alias("s")).select(*KEY, "s.spot", "s.anchor", "s.whole")
    of_anchor = found.groupBy("anchor").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), (F.min("whole") != F.max("whole")).alias("mixed")).where("lo < hi")
    # A key of its own makes the planner deal both sides of a join anew, and so lets it split what very many rows have.
    flip = lambda c: F.bitwise_not(c).alias("flipped")
    at_shared = written(found.withColumn("flipped", flip("anchor")).join(of_anchor.select(flip("anchor"), "mixed"), "flipped").drop("flipped"))
    earliest = at_shared.groupBy("anchor", "whole").agg(F.min("did").alias("m")).select("anchor", flip("whole"), "m")
    judged = at_shared.withColumn("flipped", flip("whole")).join(earliest, ["anchor", "flipped"])
    gone, opened = F.when(F.col("did") > F.col("m"), F.col("spot")), F.when((F.col("did") == F.col("m")) & F.col("mixed"), F.col("spot"))
    judged = judged.select(*KEY, gone.alias("gone"), opened.alias("opened")).where("gone IS NOT NULL OR opened IS NOT NULL")
    lists = cut(judged.groupBy(*KEY).agg(F.collect_set("gone").alias("gone"), F.collect_set("opened").alias("opened")))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and window hashes of the opened stretches."""
        hasher = Hasher()
        for batch in spans(batches, "text"):
            out: list[tuple] = []
            for row, (opened, text) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                spots, words = opened.values.to_numpy(), text.as_py().encode().split()
                first, count = spots >> 7, (spots & 127) - WINDOW + 1
                ends = np.cumsum(count)
                starts = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
                windows = np.split(hasher.runs(hasher.prefix(hasher.words(words)), starts, WINDOW).view(np.int64), ends[:-1])
                out += [(row, s, b" ".join(words[s >> 7 : (s >> 7) + (s & 127)]), w) for s, w in zip(spots.tolist(), windows, strict=True)]
            rows, spots, context, windows = zip(*out, strict=True)
            own = [batch.column(i).take(pa.array(rows)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(spots), pa.array(context, pa.binary()), pa.array(windows, pa.list_(pa.int64()))], names=[*KEY, "spot", "context", "windows"])

    needs = lists.where(F.size("opened") > 0).select(*KEY, "opened")
    asked = maybe_in(source, KEY, needs).join(needs, KEY).select(*KEY, "opened", "text")
    several = written(asked.mapInArrow(look, f"{longs(*KEY, 'spot')}, context binary, windows array<long>").withColumn("ref", F.monotonically_increasing_id()))
    seeds = several.select("did", "ref", F.posexplode("windows").alias("i", "window"))
    holder = seeds.groupBy("window").agg(F.min(F.struct("did", "ref", "i")).alias("h"), F.max("did").alias("hi")).where("h.did < hi").select(flip("window"), "h")
    hits = seeds.withColumn("flipped", flip("window")).join(holder, "flipped").where("did > h.did")
    # All windows of a stretch hold its anchor, so that those that match at the same shift belong to one maximal repeat.
    pairs = hits.groupBy("ref", F.col("h.ref").alias("of"), (F.col("i") - F.col("h.i")).alias("shift")).agg(F.min("i").alias("i"))

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "context"):
            out = []
            for s, left, right, i, shift in zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True):
                at, n = extended(left.split(b" "), right.split(b" "), i, i - shift)
                out.append((s >> 7) + at << 7 | n if n else None)
            kept = pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, pa.int64())], names=[*KEY, "spot"])
            yield kept.filter(kept.column(3).is_valid())

    met = pairs.join(several.drop("windows"), "ref").join(several.select(F.col("ref").alias("of"), F.col("context").alias("other")), "of")
    repeats = met.select(*KEY, "spot", "context", "other", "i", "shift").mapInArrow(extend, longs(*KEY, "spot"))
    ends = repeats.groupBy(*KEY).agg(F.collect_set("spot").alias("gone"))
    verdicts = cut(lists.where(F.size("gone") > 0).select(*KEY, "gone").unionByName(ends).groupBy(*KEY).agg(F.flatten(F.collect_list("gone")).alias("gone")))

    extra = F.struct(*(F.col(c) for c in carry)).alias("extra") if carry else F.struct(F.lit(0).alias("none")).alias("extra")
    whole_rows = docs.select(*key, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), extra)
    types = {f: whole_rows.schema[f].dataType.simpleString() for f in ("id", "extra")}

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text"):
            n, removed, sha, kept_text = [], [], [], []
            for text, spots in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                total = len(words)
                if spots.is_valid:
                    step, runs = np.zeros(total + 1, np.int64), spots.values.to_numpy()
                    np.add.at(step, runs >> 7, 1)
                    np.add.at(step, (runs >> 7) + (runs & 127), -1)
                    words = [w for w, depth in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not depth]
                line = b" ".join(words)
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(line).hexdigest())
                kept_text.append((line.decode() if spots.is_valid else text.as_py()) if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string()), batch.column(3)],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text", "extra"],
            )

    untouched = maybe_in(whole_rows, KEY, verdicts, without=True).withColumn("gone", F.lit(None).cast("array<long>"))
    touched = maybe_in(whole_rows, KEY, verdicts).join(verdicts, KEY, "left")
    rows = untouched.unionByName(touched).select("id", "text", "gone", "extra")
    out = rows.mapInArrow(strip, f"id {types['id']}, n_words long, n_removed long, kept_sha256 string, kept_text string, extra {types['extra']}")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text, *(F.col(f"extra.{c}") for c in carry))
