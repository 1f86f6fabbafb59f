"""Near-duplicate lines by a segment-partition edit join (the idea of Pass-Join, Li et al., 2011).

A line is cut into DISTANCE + 1 segments; a line within DISTANCE edits has one of them unchanged, at a place that lengths
bound. Lines therefore emit a row per own segment and a row per substring that the length-aware selection says could be a
segment of a line as long or shorter; rows of equal key meet, sorted, in a stream. A pair that meets is dropped if the counts
of 16 classes of characters differ by more than edits can make; what is left is compared in full, by a banded bit-parallel
edit distance over many pairs at once. Rows hold hashes and counts; only the texts of lines in such pairs are joined.

A key that very many lines have makes no pairs: its rows get longer keys, from the segments of what the key leaves of each line,
as often as it takes. Lines of a template so meet by what they differ in, and no run of rows is held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import cut, join_split, maybe_in, spans, written
from tidecast.llm.components import labelled

PAIRS = 4096
CELLS = 2_000_000
#: A key of more pairs than this, or of more rows in a stream than may be held, is made longer.
MANY, HELD = 4_000_000, 100_000
MET = ["a", "b", "k", "asks", "h", "sketch", "edits", "rest"]


def cuts(length: int, distance: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a line of that length."""
    size, longer = divmod(length, distance + 1)
    sizes = [size + (i >= distance + 1 - longer) for i in range(distance + 1)]
    return list(zip(np.r_[0, np.cumsum(sizes)[:-1]].tolist(), sizes, strict=True))


def places(length: int, shorter: int, distance: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line that may equal a segment of a line with length - shorter letters.

    The unchanged segment number i (from 0) that is looked for has at most i edits before it and distance - i after it.
    """
    out = []
    for i, (start, size) in enumerate(cuts(length - shorter, distance)):
        low = max(start - i, start + shorter - (distance - i), 0)
        high = min(start + i, start + shorter + (distance - i), length - size)
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


def allowed(length: int, distance: int, similarity: float) -> int:
    """How many edits two lines may be apart of which the longer one has so many letters."""
    return min(distance, int(length * (1 - similarity) + 1e-9))


def own_keys(length: int, edits: int) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the segments of a line; length, edits and segment are part of the seed."""
    return [((length << 8) + (edits << 4) + i, at, at + size) for i, (at, size) in enumerate(cuts(length, edits))]


def ask_keys(length: int, edits: int, over: int = -1) -> list[tuple[int, int, int]]:
    """The same of the substrings to look up in lines as long or shorter, of more than ``over`` letters."""
    return [((length - d << 8) + (edits << 4) + i, at, at + size) for d in range(min(edits, length) + 1) if length - d > over for i, at, size in places(length, d, edits)]


_plans: dict[tuple, tuple[list, list]] = {}


def plan_of(length: int, distance: int, similarity: float) -> tuple[list, list]:
    """What a line of that length emits as the shorter one of a pair, by the edits that its longer partners allow, and as the longer one."""
    if (length, distance, similarity) not in _plans:
        if len(_plans) > 20_000:
            _plans.clear()
        schemes = {e for d in range(distance + 1) if (e := allowed(length + d, distance, similarity)) >= max(d, 1)}
        most = allowed(length, distance, similarity)
        _plans[length, distance, similarity] = [k for e in sorted(schemes) for k in own_keys(length, e)], ask_keys(length, most) if most else []
    return _plans[length, distance, similarity]


def keys_of(line: str, distance: int, similarity: float = 0.0) -> tuple[list[int], list[int]]:
    """Hashes of the line's segments, and of the substrings to look up."""
    own, ask = plan_of(len(line), distance, similarity)
    digest = xxhash.xxh64_intdigest
    return [[*{(seed, a): digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for seed, a, b in some}.values()] for some in (own, ask)]  # type: ignore[return-value]


def longer_keys(k: int, asks: bool, edits: int, rest: str) -> list[tuple[int, int, str]]:
    """(key, edits, what is left) of a row of a crowded key: what its key leaves of the line is cut and looked up in the same way.

    Two lines that agree on the key's substring are within the edits only if what is left of them is. What is hardly longer
    than the edits is not cut any more: the key is then final, with no edits to go by.
    """
    prefix, n = k.to_bytes(8, "little", signed=True), len(rest)
    digest = lambda what, seed: int(np.array(xxhash.xxh64_intdigest(prefix + what, seed), np.uint64).view(np.int64))
    ends = [(digest(b"", n - d), 0, "") for d in range(min(edits, n) + 1 if asks else 1) if n - d <= 2 * edits]
    some = ask_keys(n, edits, 2 * edits) if asks else [] if ends else own_keys(n, edits)
    return ends + [(digest(rest[a:b].encode("utf-8", "surrogatepass"), seed), edits, rest[:a] + rest[b:]) for seed, a, b in some]


def sketches(lines: list[str]) -> np.ndarray:
    """Per line 16 counts of character classes, modulo 16, in 64 bits."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    letters = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = (letters * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(lines)) * 16, size) + kind, minlength=16 * len(lines)).reshape(-1, 16)
    return ((count & 15).astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def alike(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether the counts differ by at most two for each edit."""
    total = np.zeros(len(a), np.uint8)
    for shift in range(0, 64, 4):
        d = ((a >> np.uint64(shift)) - (b >> np.uint64(shift)) & np.uint64(15)).astype(np.uint8)
        total += np.minimum(d, 16 - d)
    return total <= 2 * distance


def within(left: list[str], right: list[str], distance: int) -> np.ndarray:
    """Edit distance of each pair if it is at most ``distance``, else -1, by bit-vectors of a band along the diagonal.

    Bit 63 of a vector is the band's lowest row, ``distance`` below the diagonal; vectors move down a row with each letter of
    the shorter line, so that a step is a dozen operations for all pairs together. Until the band's lowest row is the last row
    the distance is followed along the band's edge, and then along the last row.
    """
    a, b = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(left, right, strict=True)), strict=True) if left else ((), ())
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    rows = np.full((len(a), int(m.max(initial=0)) + 2 * distance + 1), 0xFFFFFFFF, np.uint32)
    cols = np.full((len(a), int(n.max(initial=0))), 0xFFFFFFFE, np.uint32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        rows[i, distance : distance + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        cols[i, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    u = np.uint64
    vp = np.full(len(a), ((1 << distance + 1) - 1) << 63 - distance, u)
    vn, score, top = np.zeros(len(a), u), np.full(len(a), distance), u(63)
    for j in range(cols.shape[1]):
        equal = np.zeros(len(a), u)
        for r in range(2 * distance + 1):  # row j + distance - r of the longer line
            equal |= (rows[:, j + 2 * distance - r] == cols[:, j]).astype(u) << u(63 - r)
        d0 = (((equal & vp) + vp) ^ vp) | equal | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        past = j - (m - distance)  # steps since the band's lowest row left the line
        at = (u(62) - np.clip(past, 0, 62).astype(u)).astype(u)
        along = (hp >> at & u(1)).astype(np.int64) - (hn >> at & u(1)).astype(np.int64)
        score += np.where(j >= n, 0, np.where(past < 0, 1 - (d0 >> top).astype(np.int64), along))
        d0 >>= u(1)
        vp, vn = hn | ~(d0 | hp), d0 & hp
    score = np.where(m - n <= distance, score, distance + 1)
    return np.where(score <= distance, score, -1)


def numbers(lines: list[str]) -> np.ndarray:
    """128 bits of each line, as two columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), ">i8").reshape(-1, 2).astype(np.int64)


class Crowds:
    """Runs of equal keys in a sorted stream of rows (k, asks, h, sketch, edits, rest): pairs of an own segment and a look-up, or,
    where these would be very many, the rows of the run, whose key has to be made longer. Rows that are held have a bound."""

    def __init__(self, distance: int):
        self.distance, self.crowd = distance, None

    def pairs(self, k: np.ndarray, asks: np.ndarray, h: np.ndarray, sketch: np.ndarray, size: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every look-up with each own segment of its run (which come first), in blocks of bounded size."""
        starts = np.cumsum(size) - size
        who = np.flatnonzero(asks & np.repeat(own > 0, size))
        begin, many = np.repeat(starts, size)[who], np.repeat(own, size)[who]
        total = np.cumsum(many)
        lo = 0
        while lo < len(who):
            before = int(total[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + CELLS, "right")))
            for first in range(0, int(many[lo:hi].max()), CELLS):  # a single look-up may have very many
                some = np.clip(many[lo:hi] - first, 0, CELLS)
                q = np.repeat(who[lo:hi], some)
                p = np.repeat(begin[lo:hi] + first - (np.cumsum(some) - some), some) + np.arange(some.sum())
                ok = alike(sketch[p].view(np.uint64), sketch[q].view(np.uint64), self.distance) & (h[p] != h[q])
                if ok.any():
                    both = np.unique(np.stack([np.minimum(h[p[ok]], h[q[ok]]), np.maximum(h[p[ok]], h[q[ok]])], axis=1), axis=0)
                    yield both[:, 0], both[:, 1]
            lo = hi

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            batch = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
            k = batch.column(0).to_numpy()
            change = np.flatnonzero(k[1:] != k[:-1])
            end = int(change[-1]) + 1 if len(change) else 0
            yield from self.settled(batch.slice(0, end))
            held = batch.slice(end)
            if held.num_rows > HELD and held.column(4)[0].as_py() != 0:  # goes on as it comes
                self.crowd = int(k[-1])
                yield from self.settled(held)
                held = held.slice(0, 0)
        if held is not None:
            yield from self.settled(held)

    def settled(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        k, asks, h, sketch = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[starts, len(k)])
        own = size - np.add.reduceat(asks.astype(np.int64), starts)
        last = pc.equal(batch.column(4), 0).fill_null(False).to_numpy(zero_copy_only=False)[starts]
        crowded = (k[starts] == self.crowd if self.crowd is not None else np.zeros(len(starts), bool)) | ~last & (own * (size - own) > MANY)
        few = np.repeat(~crowded & (own > 0) & (own < size), size)
        for a, b in self.pairs(k[few], asks[few], h[few], sketch[few], size[~crowded & (own > 0) & (own < size)], own[~crowded & (own > 0) & (own < size)]):
            none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=MET)
        if crowded.any():
            rows = batch.filter(pa.array(np.repeat(crowded, size)))
            none = [pa.nulls(rows.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*none, *rows.columns], names=MET)


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, similarity: float = 0.8) -> DataFrame:
    """One row per line: ``id_col``, line_no, class_doc_id, class_line_no, n_links, kept.

    Lines are what newlines divide, numbered from 0. Two different lines are linked if at most ``distance`` edits (insert, delete
    or replace a code point) apart and their similarity, one less edits by the longer one's length, is ``similarity`` or more;
    equal lines are one from the start. A class is what links connect; its first occurrence, by identifier and line number, is
    the class's name and is ``kept``. n_links counts the different lines that the row's line is linked with. A null text has
    no lines, an empty one has one empty line. A null identifier comes after all others. Repeated rows repeat their
    lines, and each of them is kept or not as its equal is. An empty table gives an empty result. Other columns are ignored,
    whatever their names. Lines may be of any length. They are told apart by 128 bits; links are verified on the texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    least = next(n for n in range(10**6) if any(plan_of(n, distance, similarity)))

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text"):
            lines = [t.as_py().split("\n") for t in batch.column(1)]
            size = np.fromiter(map(len, lines), np.int64, len(lines))
            h, at = numbers([x for ls in lines for x in ls]), np.repeat(np.arange(len(lines)), size)
            columns = [np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size), h[:, 0], h[:, 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["id", "line_no", "h", "h2"])

    def distinct_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Lines of the batches with their numbers, without those already seen of late."""
        seen: set[bytes] = set()
        for batch in spans(batches, "text", 500_000):
            lines = list(dict.fromkeys(x for t in batch.column(0) for x in t.as_py().split("\n") if len(x) >= least))
            h = numbers(lines)
            new = [i for i in range(len(lines)) if not ((k := h[i].tobytes()) in seen or seen.add(k))]
            if len(seen) > 500_000:
                seen.clear()
            if new:
                yield [lines[i] for i in new], h[new]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, h in distinct_lines(batches):
            keys, asks, size = [], [], []
            for line in lines:
                own, ask = keys_of(line, distance, similarity)
                keys += own + ask
                asks += [False] * len(own) + [True] * len(ask)
                size.append(len(own) + len(ask))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(asks, pa.bool_()), pa.array(np.repeat(h[:, 0], size)), pa.array(np.repeat(sketches(lines).view(np.int64), size))], names=["k", "asks", "h", "sketch"])

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, h in distinct_lines(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(lines, pa.string())], names=["h", "h2", "line"])

    def lines_of(wanted: DataFrame) -> DataFrame:
        found = maybe_in(source.select("text").mapInArrow(texts, "h long, h2 long, line string"), "h", wanted).join(wanted, "h", "left_semi")
        return found.groupBy("h", "h2").agg(F.first("line").alias("line"))

    def lengthen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of crowded keys with longer keys. In the first round the line is there, and its key has to be found in it again."""
        for batch in spans(batches, "rest"):
            out: list[tuple] = []
            for k, asks, h, sketch, edits, rest, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line is None:
                    found = [(edits, rest)]
                else:
                    some = plan_of(len(line), distance, similarity)[asks]
                    same = lambda seed, a, b: xxhash.xxh64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), seed) == k & (1 << 64) - 1  # noqa: B023, E731
                    found = list(dict.fromkeys((seed >> 4 & 15, line[:a] + line[b:]) for seed, a, b in some if same(seed, a, b)))
                out += [(new, asks, h, sketch, e, r) for edits, rest in found for new, e, r in longer_keys(k, asks, edits, rest)]
            if out:
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=MET[2:])

    spots = cut(source.mapInArrow(occurrences, f"id {kind}, line_no long, h long, h2 long"))
    made = source.select("text").mapInArrow(rows, "k long, asks boolean, h long, sketch long").select("*", F.lit(None).cast("int").alias("edits"), F.lit(None).cast("string").alias("rest"))
    candidates, first_round = None, True
    while True:
        met = made.repartition("k").sortWithinPartitions("k", "asks", "h").mapInArrow(Crowds(distance), "a long, b long, k long, asks boolean, h long, sketch long, edits int, rest string")
        met = cut(met)
        pairs = met.where("a IS NOT NULL").select("a", "b")
        candidates = pairs if candidates is None else candidates.unionByName(pairs)
        crowds = met.where("a IS NULL").select(*MET[2:])
        if crowds.isEmpty():
            break
        if first_round:  # rows of equal lines from several tasks are the same
            crowds = crowds.distinct().join(lines_of(crowds.select("h").distinct()).select("h", "line"), "h")
        else:
            crowds = crowds.withColumn("line", F.lit(None).cast("string"))
        made, first_round = crowds.select(*MET[2:], "line").mapInArrow(lengthen, "k long, asks boolean, h long, sketch long, edits int, rest string"), False

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "left"):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right, strict=True)), np.int64, len(left))
            order, good = np.argsort(size, kind="stable"), np.zeros(len(left), bool)
            i = 0
            while i < len(order):  # pairs of like length together, less of them the longer they are
                some = order[i : i + max(1, min(PAIRS, CELLS // max(1, int(size[order[min(i + PAIRS, len(order)) - 1]]))))]
                edits = within([left[j] for j in some], [right[j] for j in some], distance)
                good[some] = (edits >= 0) & (edits <= np.array([allowed(int(n), distance, similarity) for n in size[some]]))
                i += len(some)
            yield batch.select([0, 1]).filter(pa.array(good))

    candidates = cut(candidates.distinct())
    lines = written(lines_of(candidates.select(F.explode(F.array("a", "b")).alias("h")).distinct()).withColumn("node", F.monotonically_increasing_id()))
    left, right = (lines.select(F.col("h").alias(x), F.col("node").alias(f"node_{x}"), F.col("line").alias(f"line_{x}")) for x in "ab")
    links = cut(candidates.join(left, "a").join(right, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("line_a").alias("left"), F.col("line_b").alias("right")).mapInArrow(verify, "a long, b long"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    first = spots.groupBy("h", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("line_no"))).alias("first"))
    nodes = cut(lines.select("node", "h", "h2").join(first, ["h", "h2"]))
    classes = nodes.select("node", "h", "h2").join(labelled(nodes, "node", "first", links), "node").join(degree, "node", "left")
    named = first.join(classes, ["h", "h2"], "left").select("h", "h2", F.coalesce("component_id", "first").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = join_split(spots.withColumnRenamed("h2", "other"), named, "h").where("other = h2")
    kept = F.col("id").eqNullSafe(F.col("class.id")) & (F.col("line_no") == F.col("class.line_no"))
    return joined.select(F.col("id").alias(id_col), "line_no", F.col("class.id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))
