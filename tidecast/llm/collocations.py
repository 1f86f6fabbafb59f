"""Phrase collocations: suffix automata per shard count the phrases, a global sum decides, suffix links find what a longer phrase covers.

The suffix links of an automaton are the tree of its words read backwards, and its states the classes of phrases with the same
end positions. So a shard's states come out of a sort of the reversed contexts of its words: runs that agree in their last d
words are the end positions of a phrase of d words. A state stands for its longest phrase and, down to one word more than its
link, for its suffixes; its endpos count is the length of the run. Depth is bounded by the longest phrase asked for.

Equal contexts are summed before they are dealt to shards, so that each lies in one shard only: the automata give at most
``longest - 2`` rows for each different context, however many shards there are.

A phrase is as frequent as it has to be only if its words, its pairs and its runs of three are. Words are summed first, then pairs
of frequent words, then runs of three by slots of a table; longer phrases come from the automata, which leave out what crosses a
run that is too rare. These filters have a fixed size and go by hash: where they let too much pass, the automata give more rows,
at most those of each different context, and the exact sums drop them. Words are told apart by 64 bits in the sums of pairs, and as they are
in all others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import join_split, spans, written
from tidecast.llm.words import Words, classes, mixed

#: Bytes of text that are cut together, contexts of an automaton, and bits of a filter.
SHARD, LARGEST, BITS = 4_000_000, 1 << 18, 1 << 25
#: Slots of the table of runs of three, and those that travel together.
SLOTS, CHUNK = 1 << 22, 1 << 16
PIECES = classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
SEED = 42


def automaton(ids: np.ndarray, depth: np.ndarray, most: int) -> dict[str, np.ndarray]:
    """The states of the suffix automaton of word ids (of several pieces: a generalised one), as far as phrases of ``most`` words need.

    ``depth`` is how many words, at most ``most``, the piece has up to and with each position. By state: ``end`` is a position
    where its phrases end, ``longest`` and ``shortest`` their lengths, ``count`` the number of their end positions, and ``link``
    the state of the next shorter suffix, -1 for the empty one.
    """
    m = len(ids)
    if not m:
        return {c: np.empty(0, np.int64) for c in ("end", "longest", "shortest", "count", "link")}
    back = np.full((m, most), -1, np.int64)
    for d in range(min(most, m)):
        back[d:, d] = np.where(depth[d:] > d, ids[: m - d], -1)
    return joined(back, np.ones(m, np.int64))


def joined(back: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The states of reversed contexts, a row each with -1 behind its last word, that occur ``weight`` times; ``end`` is a row."""
    m, most = back.shape
    order = np.lexsort(back.T[::-1])
    back, weight = back[order], weight[order]
    lcp = np.r_[0, np.minimum.accumulate((back[1:] == back[:-1]) & (back[1:] >= 0), axis=1).sum(axis=1)]  # with the row before
    first, size = np.full((most + 1, m), -1), np.zeros((most + 1, m), np.int64)  # by depth and row: its run's first row and weight
    first[0], size[0] = 0, weight.sum()
    for d in range(1, most + 1):
        rows = np.flatnonzero(back[:, d - 1] >= 0)
        if not len(rows):
            break
        new = lcp[rows] < d
        first[d, rows] = rows[new][np.cumsum(new) - 1]
        size[d, rows] = np.add.reduceat(weight[rows], np.flatnonzero(new))[np.cumsum(new) - 1]
    number, found = np.full((most + 1, m), -1), []
    for d in range(1, most + 1):
        rows = np.flatnonzero(first[d] == np.arange(m))
        # A run that is all of a longer phrase's is no state of its own.
        own = rows if d == most else rows[(first[d + 1, rows] != rows) | (size[d + 1, rows] != size[d, rows])]
        number[d, own] = np.arange(len(own)) + sum(len(f[0]) for f in found)
        shortest = np.full(len(own), d)
        for e in range(d - 1, 0, -1):  # down to where the run is wider
            shortest[(shortest == e + 1) & (size[e, own] == size[d, own])] = e
        parent = np.maximum(shortest - 1, 0)
        link = np.where(parent > 0, number[parent, first[parent, own]], -1)
        found.append((order[own], np.full(len(own), d), shortest, size[d, own], link))
    return dict(zip(("end", "longest", "shortest", "count", "link"), map(np.concatenate, zip(*found, strict=True)), strict=True))


def substrings(states: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End position, length and count of each different phrase of the automaton."""
    many = states["longest"] - states["shortest"] + 1
    at = np.repeat(np.arange(len(many)), many)
    length = np.repeat(states["shortest"], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return states["end"][at], length, states["count"][at]


class Shard:
    """Words of some texts with their languages; ``ids`` number the different pairs of a language and a word."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        words = Words(batch.column("text"), PIECES)
        coded, lang = words.column().dictionary_encode(), batch.column("lang").dictionary_encode()
        names, v = lang.dictionary.to_pylist(), max(1, len(coded.dictionary))
        both = lang.indices.to_numpy()[words.row].astype(np.int64) * v + coded.indices.to_numpy()
        different, self.ids, self.counts = np.unique(both, return_inverse=True, return_counts=True)
        self.lang = lang.dictionary.take(pa.array(different // v)).cast(pa.string())
        self.word = coded.dictionary.take(pa.array(different % v)).cast(pa.string())
        self.piece = words.piece
        of_lang = {n: xxhash.xxh64_intdigest(n.encode(), SEED) for n in names}
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w.encode(), of_lang[x]) for x, w in zip(self.lang.to_pylist(), self.word.to_pylist(), strict=True)), np.uint64, len(different))

    def pairs(self, frequent: np.ndarray) -> np.ndarray:
        """Positions whose word goes on to the next one in the same piece, both frequent by the filter."""
        good = seen(frequent, self.hash)[self.ids]
        return np.flatnonzero((self.piece[1:] == self.piece[:-1]) & good[1:] & good[:-1])

    def triples(self, frequent: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Positions of three words in a row whose pairs are both frequent by the filters."""
        at, goes_on = self.pairs(frequent), np.zeros(len(self.ids), bool)
        goes_on[at[seen(together, paired(self.hash[self.ids[at]], self.hash[self.ids[at + 1]]))]] = True
        return np.flatnonzero(goes_on[:-1] & goes_on[1:])

    def slots(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of three words from each position on."""
        h = paired(paired(self.hash[self.ids[at]], self.hash[self.ids[at + 1]]), self.hash[self.ids[at + 2]])
        return (h & np.uint64(size - 1)).astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) + b)


def chunk(at: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pa.compress(part.astype("<i8").tobytes(), "zstd", asbytes=True)])], names=["at", "counts"])


def chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    return (chunk(i, part) for i, part in enumerate(total.reshape(-1, CHUNK)) if part.any())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(bytes(data), 8 * CHUNK, "zstd", asbytes=True), "<i8")


def seen(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def bitmap(hashes: DataFrame) -> Broadcast:
    """The filter of BITS bits, whatever the number of hashes ``h``."""
    words = hashes.select((F.col("h").bitwiseAND(BITS - 1)).alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, least: int, longest: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with ``least`` occurrences or more (lang, phrase, words, f), and each lang's number of words (lang, n)."""
    source = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text", SHARD):
            s = Shard(batch)
            yield pa.RecordBatch.from_arrays([s.lang, s.word, pa.array(s.counts)], names=["lang", "word", "n"])

    every = written(source.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    total = written(every.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = bitmap(every.where(F.col("n") >= least).select(F.xxhash64("lang", "word").alias("h")))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs by the hashes of their words."""
        for batch in spans(batches, "text", SHARD):
            s = Shard(batch)
            two, v = s.pairs(frequent.value), max(1, len(s.hash))
            pair, n = np.unique(s.ids[two] * v + s.ids[two + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.hash[pair // v].view(np.int64)), pa.array(s.hash[pair % v].view(np.int64)), pa.array(n)], names=["h", "h2", "n"])

    often = written(source.mapInArrow(pairs, "h long, h2 long, n long").groupBy("h", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(paired(*(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))).view(np.int64))], names=["h"])

    together = bitmap(often.select("h", "h2").mapInArrow(hashed, "h long"))

    def triples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many runs of three words, by frequent pairs, fall into each slot of a table; in chunks."""
        total = np.zeros(SLOTS, np.int64)
        for batch in spans(batches, "text", SHARD):
            s = Shard(batch)
            total += np.bincount(s.slots(s.triples(frequent.value, together.value), SLOTS), minlength=SLOTS)
        yield from chunks(total)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[at] = unpacked(packed) + held.get(at, 0)
        for at, part in held.items():
            yield chunk(at, part)

    kind = "at int, counts binary"
    # Runs that share a slot count together: that only lets more pass.
    crowded = np.zeros(SLOTS, bool)
    for at, packed in source.mapInArrow(triples, kind).repartition("at").mapInArrow(added, kind).collect():  # SLOTS numbers
        crowded[at * CHUNK : (at + 1) * CHUNK] = unpacked(packed) >= least
    often_three = source.sparkSession.sparkContext.broadcast(crowded)

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each position where a run of three ends that may be frequent, by the words up to it; Spark sums what is equal."""
        for batch in spans(batches, "text", SHARD):
            s = Shard(batch)
            at = s.triples(frequent.value, together.value)
            at = at[often_three.value[s.slots(at, SLOTS)]]
            ends = np.zeros(len(s.ids), bool)
            ends[at + 2] = True
            reach = np.zeros(len(s.ids), np.int64)  # how many words before a position its phrases may have
            reach[at + 1] = 1
            for _ in range(longest - 2):
                reach[1:] = np.where(ends[1:], np.minimum(reach[:-1] + 1, longest - 1), reach[1:])
            for d in range(3, longest + 1):
                here = np.flatnonzero(ends & (reach == d - 1))
                text = pc.binary_join_element_wise(*(s.word.take(pa.array(s.ids[here - d + 1 + i])) for i in range(d)), " ")
                yield pa.RecordBatch.from_arrays([s.lang.take(pa.array(s.ids[here])), text], names=["lang", "phrase"])

    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shard of an automaton are contexts of a task, LARGEST at most."""
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            words = pc.split_pattern(own.column("phrase").combine_chunks(), " ")
            stop, coded = words.offsets.to_numpy()[1:], words.values.dictionary_encode()
            size, ids = np.diff(words.offsets.to_numpy()), coded.indices.to_numpy().astype(np.int64)
            lang = own.column("lang").combine_chunks()
            of = lang.dictionary_encode().indices.to_numpy().astype(np.int64) * len(coded.dictionary)
            back = np.full((len(size), longest), -1, np.int64)
            for d in range(longest):
                has = size > d
                back[has, d] = ids[stop[has] - 1 - d] + of[has]
            end, length, count = substrings(joined(back, own.column("n").to_numpy()))
            for d in range(3, longest + 1):
                here = end[length == d]
                text = pc.binary_join_element_wise(*(coded.dictionary.take(pa.array(ids[stop[here] - d + i])) for i in range(d)), " ")
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(here)), text, pa.array(np.full(len(here), d, np.int32)), pa.array(count[length == d])], names=["lang", "phrase", "words", "f"])

        for batch in batches:
            for lo in range(0, batch.num_rows, LARGEST):
                part = batch.slice(lo, LARGEST)
                if sum(len(x) for x in held) + len(part) > LARGEST:
                    yield from out()
                held.append(part)
        if held:
            yield from out()

    summed = source.mapInArrow(contexts, "lang string, phrase string").groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("n"))
    more = summed.mapInArrow(phrases, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    names = every.where(F.col("n") >= least).select(F.xxhash64("lang", "word").alias("h"), "lang", "word")
    two = join_split(often, names, "h").withColumnRenamed("word", "first").withColumnRenamed("h", "h1").withColumnRenamed("h2", "h")
    two = join_split(two, names.select("h", "word"), "h").select("lang", F.concat_ws(" ", "first", "word").alias("phrase"), F.lit(2).alias("words"), F.col("n").alias("f"))
    one = every.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return written(one.unionByName(two).unionByName(more) if longest > 2 else one.unionByName(two)), total


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. A
    phrase of 2 to ``longest`` words that occurs ``a >= least`` times scores floor(1000 * a * n / (l * r)) at its lowest cut,
    the first one in ties; l and r are the occurrences of the parts, n all words of the language. A phrase that lies inside a
    longer one of as many occurrences is dropped. Order: score and a descending, phrase ascending by bytes. A null language is
    ``und``, a null text empty. Repeated rows count as often. An empty table gives an empty result. Texts of any length are
    counted whole. Other columns are ignored, whatever their names.
    """
    counted, total = phrase_counts(docs, least, longest, text_col, lang_col)
    several = counted.where("words >= 2").withColumnRenamed("f", "a")
    # If a longer phrase covers this one as often as it occurs, then one that is longer by a word does: the phrase is its suffix
    # link or its stem, and has the same count.
    shorter = lambda lo: F.expr(f"array_join(slice(split(phrase, ' '), {lo}, words - 1), ' ')")
    covered = several.where("words >= 3").select("lang", F.explode(F.array(shorter(2), shorter(1))).alias("phrase"), "a").distinct()
    kept = several.join(covered, ["lang", "phrase", "a"], "left_anti")
    part = lambda lo, n: F.expr(f"array_join(slice(split(phrase, ' '), {lo}, {n}), ' ')")
    cuts = kept.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part("1", "k").alias("left"), part("k + 1", "words - k").alias("right"))
    of = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", (wide("a") * 1000 * wide("n")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = cuts.select("lang", "phrase", "a", "n", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    scored = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
