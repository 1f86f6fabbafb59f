"""Words of whole batches in numpy: bounds by the class of each byte, hashes, and dictionaries by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are looked at together.
STEP = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of odd words: the factor of the hash of a word, a bijection of 64 bits, and its inverse.
FACTOR = 0x9E3779B97F4A7C1B
INVERSE = pow(FACTOR, -1, 1 << 64)


def classes(blanks: bytes, stops: bytes = b"") -> np.ndarray:
    """By byte: 0 of a word, 1 a blank, 2 a stop that ends a piece of text."""
    table = np.zeros(256, np.uint8)
    table[list(blanks)], table[list(stops)] = 1, 2
    return table


#: Words end at white space of ASCII.
SPACED = classes(b"\x20\x09\x0a\x0b\x0c\x0d")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))


class Words:
    """The words of a column of texts, lower-cased (A-Z only): ``start`` and ``end`` byte, the row of its text, the piece of the text.

    Pieces are numbered through; they end at stops and with their text. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray = SPACED) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.table, self.offsets = table, offsets - offsets[0]
        self.data = LOWER[raw]
        starts, ends, stops, passed, n = [], [], [], 0, len(raw)
        first = np.zeros(n + 1, bool)  # whether a text begins at the byte
        first[self.offsets] = True
        for lo in range(0, n, STEP):
            hi = min(lo + STEP, n)
            kind = table[self.data[max(lo - 1, 0) : min(hi + 1, n)]]
            word = np.r_[np.zeros(int(lo == 0), bool), kind == 0, np.zeros(int(hi == n), bool)]  # with a byte before and one after
            before, own, after = word[:-2] & ~first[lo:hi], word[1:-1], word[2:] & ~first[lo + 1 : hi + 1]
            at = np.flatnonzero(own & ~before)
            starts.append(at + lo)
            ends.append(np.flatnonzero(own & ~after) + lo + 1)
            seen = passed + np.cumsum(kind[int(lo > 0) :][: hi - lo] == 2)
            stops.append(seen[at])
            passed = int(seen[-1])
        self.start, self.end, stop = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, stops))
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.piece = np.cumsum(np.r_[True, (self.row[1:] != self.row[:-1]) | (stop[1:] != stop[:-1])]) - 1 if len(stop) else stop

    def __len__(self) -> int:
        return len(self.start)

    def column(self) -> pa.Array:
        """The words as strings."""
        kept = np.concatenate([d[self.table[d] == 0] for lo in range(0, len(self.data), STEP) if len(d := self.data[lo : lo + STEP])] or [self.data])
        offsets = np.r_[0, np.cumsum(self.end - self.start)]
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])

    def hashes(self) -> np.ndarray:
        """64 bits of each word: a polynomial of its bytes modulo 2^64, mixed with its length."""
        out, step = np.empty(len(self), np.uint64), STEP // 8
        up = np.cumprod(np.full(min(step, len(self.data)) + 1, FACTOR, np.uint64))
        down = np.cumprod(np.full(len(up), INVERSE, np.uint64))
        at = 0
        while at < len(self):
            lo = int(self.start[at])
            end = max(at + 1, int(np.searchsorted(self.end, lo + len(up), "right")))
            if end == at + 1 and self.end[at] - lo > len(up):  # one word longer than a step
                total, power = 0, 1
                for b in range(lo, int(self.end[at]), len(up)):
                    part = self.data[b : min(b + len(up), int(self.end[at]))]
                    total, power = total + power * int(np.sum(BYTES[part] * up[: len(part)], dtype=np.uint64)), power * int(up[-1])
                out[at] = total % (1 << 64)
            else:
                part = self.data[lo : int(self.end[end - 1])]
                sums = np.r_[np.uint64(0), np.cumsum(BYTES[part] * up[: len(part)], dtype=np.uint64)]
                a, b = self.start[at:end] - lo, self.end[at:end] - lo
                out[at:end] = (sums[b] - sums[a]) * down[a] * np.uint64(FACTOR)
            at = end
        return mixed(out + mixed((self.end - self.start).astype(np.uint64)))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, sorted by text and hash, and where each text's begin (and the last end).

    A shorter text is one shingle, a text without words has none.
    """
    w = Words(texts)
    own, rows = w.hashes(), np.arange(len(texts))
    del w.data
    n = np.bincount(w.row, minlength=len(texts)) if len(w) else np.zeros(len(texts), np.int64)
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    length = np.repeat(np.minimum(n, words), count)
    total = np.zeros(len(at), np.uint64)
    for i in range(words):
        here = i < length
        total[here] = mixed(total[here] + own[at[here] + i])
    row = np.repeat(rows, count)
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.r_[True, (total[1:] != total[:-1]) | (row[1:] != row[:-1])] if len(total) else np.empty(0, bool)
    return total[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(texts)))] if len(texts) else np.zeros(1, np.int64)
