"""Packing of tokenised documents into sequences by minimum bin slack.

What is packed is a multiset of remaining lengths below the window, so that its histogram, with at most one row per length,
is all that the driver needs whatever the size of the corpus. For each window a subset-sum dynamic programme over bitsets
finds the multiset that fills it closest to capacity; backtracking gives how many pieces of each length it takes, and the
pattern is used as many times as the counts allow. Pieces then find their place by their rank among those of equal length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.bpe import GROUP, LETTERS, NUMBERS, Merges, cut_words, gather, lists
from tidecast.llm.common import cut, spans

PIECES = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
_models: dict[str, WordBPE] = {}

#: The vocabulary's own pattern for such letters, in the syntax of Arrow's expressions; texts in which OTHER finds something go to the library.
TOKEN = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+"
OTHER = "[^\t\n\r -~\xa1-\xac\xae-\u017f]|\u0130|<\\|"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum is closest to ``capacity`` from below, as length -> times."""
    reach, mask, trail, target = 1, (1 << capacity + 1) - 1, [], 1 << capacity
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:  # any number of copies is a sum of these powers and the rest
            take = min(take, left)
            trail.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            take *= 2
            if reach & target:
                break
        if reach & target:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(histogram: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset) and the number of sequences."""
    left, used, rows, sequence = {k: v for k, v in histogram.items() if v}, dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        pattern = fill(rest, window - longest) if longest < window else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[k] // m for k, m in pattern.items()), 0
        for length, m in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], sequence, m, offset))
            used[length] += times * m
            left[length] -= times * m
            if not left[length]:
                del left[length]
            offset += length * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


class WordBPE:
    """A vocabulary whose words end at white space; the library is loaded only if a text asks for it."""

    def __init__(self, spec: str):
        self.spec, self.library, self.merges = spec, None, Merges(json.loads(spec)["model"])

    def by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text (not null). Texts of common characters are cut at white space, and equal chunks are encoded once."""
        odd = pc.match_substring_regex(texts, OTHER).to_numpy(zero_copy_only=False)
        bounds, chunks = lists(pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts))))
        coded = chunks.dictionary_encode()
        word_bounds, words = lists(cut_words(coded.dictionary, TOKEN))
        flat, counts = self.merges.encode(words)
        flat, ends = gather(flat, np.diff(np.r_[0, np.cumsum(counts)][word_bounds]), coded.indices.to_numpy())
        ends = np.r_[0, ends][bounds[1:]]
        return [self.by_library(texts[i].as_py()) if o else ids for i, (o, ids) in enumerate(zip(odd.tolist(), np.split(flat, ends[:-1]), strict=True))]


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most ``window`` ids of every document, with checksums."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    shared, name = docs.sparkSession.sparkContext.broadcast(spec), str(zlib.crc32(spec.encode()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models[name] = WordBPE(shared.value)
        for batch in spans(batches, "text", GROUP):
            out: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(_models[name].encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for column, x in zip(out, (i, at, len(piece), zlib.crc32(piece), len(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, PIECES.format(kind=kind))


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the vocabulary file (tokenizers JSON whose words end at white space), then ``end_id``. It is cut
    at multiples of ``window`` ids; full pieces are sequences of their own, and what remains of each document is packed.
    Null and empty texts are documents of the end id alone. Identifiers may be null or repeat: each row is a document. An
    empty table gives an empty result. Sequence numbers run from 0 without gaps; offsets in a sequence too. Other columns are
    ignored, whatever their names. Texts are worked on in groups of a few MB; a longer text is a group of its own.
    """
    pieces = cut(tokenize(docs, vocabulary, end_id, window, id_col, text_col)).withColumn("part", F.spark_partition_id())
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    rows, _ = plan(histogram, window)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 40  # a length and a rank in one sorted key
        starts = rows[:, 0] << shift | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = rows[np.searchsorted(starts, length << shift | rank, side="right") - 1]
            bin_no, slot = np.divmod(rank - at[:, 1], at[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(at[:, 2] + bin_no), pa.array(at[:, 4] + slot * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    own = Window.partitionBy("part", "length").orderBy("id", "start")
    ranked = pieces.withColumn("nth", F.row_number().over(own)).join(counts, ["part", "length"])
    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth") - 1).cast("long").alias("rank"))
    if not len(rows):
        placed = placed.limit(0)
    return placed.mapInArrow(place, PIECES.format(kind=kind) + ", sequence_id long, offset long").withColumnRenamed("id", id_col)
