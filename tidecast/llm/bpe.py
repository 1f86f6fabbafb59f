"""Byte-level BPE encoding and decoding with numpy merge rounds over many words at once.

A batch of texts is cut into pieces between which no token reaches, and equal pieces become one; the different words in them
go through the merge rounds together, and the texts' ids are gathered from the pieces' ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import spans

#: The pattern of this family of vocabularies; a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Two white-space characters in a row, in the syntax of Arrow's expressions, whose own class is ASCII only.
SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
NONE = np.int64(2**62)
#: Bytes of text that are worked on together.
GROUP = 8_000_000
#: How many different words go through the merge rounds together.
ROUND = 32_768
#: Letters and numbers up to U+017F, of which all tables of characters think alike.
LETTERS, NUMBERS = ("".join(c for c in map(chr, range(0x21, 0x180)) if unicodedata.category(c)[0] == k) for k in "LN")
#: The pattern for pieces of such characters without two spaces in a row, in the syntax of Arrow's expressions; ODD finds others.
PLAIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\t-\\r {LETTERS}{NUMBERS}]+|[\\t-\\r ]"
ODD = "[^\t-\r -~\xa1-\xac\xae-\u017f]"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else the next of U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def gather(flat: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code in turn, and where each one's end; ``flat`` has ``counts[c]`` values of every code c."""
    n, starts = counts[codes], np.cumsum(counts) - counts
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


class Merges:
    """The merge table of a vocabulary, and rounds of merges over many words at once.

    Where the vocabulary marks word ends by a suffix, it is part of each word's last symbol.
    """

    def __init__(self, model: dict):
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, by binary search over the sorted pair keys; NONE where no merge is known."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and how many each word has; the words are given as bytes and their sizes.

        All words lie in one flat array; every round merges each word's lowest-ranked pair, and words without one leave. A
        pair goes with its left symbol; only pairs beside a merge are searched for anew.
        """
        sym, ends = self.first[letters], (np.cumsum(size) - 1)[size > 0]
        sym[ends] = self.last[letters[ends]]
        word = np.repeat(np.arange(len(size)), size)
        rank, inner = np.full(len(sym), NONE), np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        over_ids, over_words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = best == NONE
            if over.any():
                over_ids.append(sym[over])
                over_words.append(word[over])
                rank, sym, word, best = rank[~over], sym[~over], word[~over], best[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            # Of overlapping pairs (x x in x x x) the first, third, ... merge.
            run = np.r_[False, (at[1:] == at[:-1] + 1) & (word[at[1:]] == word[at[:-1]])]
            if run.any():
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(run, 0, index))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            left = at - np.arange(len(at))
            rank[left] = NONE
            beside = np.concatenate([left, left - 1])
            beside = beside[(beside >= 0) & (beside < len(sym) - 1)]
            beside = beside[word[beside] == word[beside + 1]]
            rank[beside] = self.ranks(sym[beside], sym[beside + 1])
        ids, of = np.concatenate(over_ids), np.concatenate(over_words)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(size))

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each word has; equal words are merged once."""
        coded = words.dictionary_encode()
        bounds, letters = strings(coded.dictionary)
        parts = [self.merge(letters[bounds[i] : bounds[min(i + ROUND, len(bounds) - 1)]], np.diff(bounds[i : i + ROUND + 1])) for i in range(0, max(1, len(bounds) - 1), ROUND)]
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        codes = coded.indices.to_numpy()
        return gather(ids, counts, codes)[0], counts[codes]


def strings(array: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the strings, and all their bytes."""
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)


def lists(array: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Bounds of the lists, and all their values."""
    bounds = array.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], array.values.slice(bounds[0], bounds[-1] - bounds[0])


def cut_words(pieces: pa.StringArray, pattern: str) -> pa.ListArray:
    """The pattern's matches in each piece; a last empty one too. Pieces have no zero character."""
    return pc.split_pattern(pc.replace_substring_regex(pieces, f"({pattern})", "\\1\0"), "\0")


class ByteBPE:
    """A vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges = Merges(model["model"])
        tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.bytes_of, self.sizes = np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.split = regex.compile(SPLIT).findall

    def by_pattern(self, text: str) -> np.ndarray:
        """Ids of a text of any kind."""
        out = [np.empty(0, np.int64)]
        for i, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            out.append(np.array([self.special[part]]) if i % 2 else self.merges.encode(pa.array(self.split(part), pa.string()))[0])
        return np.concatenate(out)

    def each(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the different pieces one after the other, and how many each has."""
        odd = pc.match_substring_regex(pieces, ODD)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = cut_words(pc.if_else(odd, "", pieces) if len(at) else pieces, PLAIN)
        if len(at):  # these by the pattern itself
            own = pa.array([self.split(p) for p in pieces.take(pa.array(at)).to_pylist()], pa.list_(pa.string()))
            order = np.arange(len(pieces))
            order[at] = len(pieces) + np.arange(len(at))
            cut = pa.concat_arrays([cut, own]).take(pa.array(order))
        bounds, words = lists(cut)
        ids, counts = self.merges.encode(words)
        return ids, np.diff(np.r_[0, np.cumsum(counts)][bounds])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (not null) one after the other, and where each text's end.

        Without two white-space characters in a row no token and no decision of the pattern reaches over the place before a
        space; such texts are cut there. Others, and texts with a special token's string, go by the pattern as a whole.
        """
        odd = pc.match_substring_regex(texts, SPACES)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        bounds, pieces = lists(pc.split_pattern(pc.if_else(odd, "", texts) if len(odd_at) else texts, " "))
        coded = pieces.dictionary_encode()
        codes, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # A text's first piece has no space before it: a code of its own.
        codes[bounds[:-1]] += len(kinds)
        flat, counts = self.each(pa.concat_arrays([pc.binary_join_element_wise(" ", kinds, ""), kinds]))
        ids, ends = gather(flat, counts, codes)
        ends = ends[bounds[1:] - 1]
        if len(odd_at):
            parts, at, size = [], 0, np.diff(np.r_[0, ends])
            for i in odd_at.tolist():
                own = self.by_pattern(texts[i].as_py())
                parts += [ids[at : ends[i]], own]
                at, size[i] = ends[i], len(own)
            ids, ends = np.concatenate([*parts, ids[at:]]), np.cumsum(size)
        return ids, ends

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text; bytes that are none become the replacement character."""
        raw = gather(self.bytes_of, self.sizes, ids)[0].tobytes()
        return raw.decode("utf-8", "replace").encode()


_models: dict[str, ByteBPE] = {}


def bpe_roundtrip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode every text and decode its ids: ``id_col``, n_tokens, ids_sha256, decoded_sha256 (+ ids, decoded if kept).

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's JSON form; the driver reads it (a
    few MB) and hands it to the executors. Ids equal the library's with add_special_tokens=False and without truncation
    and padding; special tokens' strings in a text become their ids. Null texts count as empty: no ids, empty decoded
    text. Identifiers may be null or repeat: one row per input row. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Texts are worked on in groups of a few MB; a longer text is a group of its own.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    name, shared = hashlib.sha256(spec.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models[name] = ByteBPE(shared.value)
        model = _models[name]
        for batch in spans(batches, "text", GROUP):
            flat, ends = model.encode(batch.column(1))
            ids = np.split(flat, ends[:-1])
            decoded = [model.decode(x) for x in ids]
            columns = [batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t).hexdigest() for t in decoded])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                columns.append(pa.array([t.decode() for t in decoded], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
