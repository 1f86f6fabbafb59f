"""Toxicity by a classifier chain: linear models in sequence, later ones fed with the probabilities of earlier ones.

The chain's categories are label columns in order; here ``low_quality`` (the opposite of the quality label) and ``toxic``. Each
model sees binary features, hashed words and word beginnings, of which it keeps the most informative, a few ratios of
character kinds, and the probabilities of the categories before it. In training those are out of fold, so that a later model
does not learn to trust an earlier one more than it deserves.

Models are fitted on the driver from at most ``max_rows`` labelled documents, those of least hash of the identifier, a bound that
does not grow with the corpus. Scoring is a map over all whole texts, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidecast.llm.common import spans

WORD = re.compile(r"[^\W\d_]+")
BITS = 20
STARTS = (4, 5, 6)
KEEP, FOLDS, STEPS = 1500, 4, 150
#: Chosen on held-out documents; the figures are in the README.
THRESHOLD = 0.3


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    raw = word.encode("utf-8", "replace")
    out = [zlib.crc32(b"w" + raw)]
    out += [zlib.crc32(b"s" + word[:n].encode("utf-8", "replace")) for n in STARTS if len(word) > n]
    return [x & (1 << BITS) - 1 for x in out]


def ratios(text: str, words: int) -> tuple[float, ...]:
    """Kinds of characters and lengths, each between 0 and about 1."""
    n = max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = sum(map(text.count, "#$%&*!|=<>{}@"))
    return (upper / n * 2, min(1.0, marks / n * 10), sum(map(text.count, "0123456789")) / n * 2, min(1.0, text.count("\n") / n * 50), min(1.0, 3 * words / n), 1.0)


def text_features(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, tuple[float, ...]]:
    words = WORD.findall(text.lower())
    out: set[int] = set()
    for w in set(words):
        if (f := known.get(w)) is None:
            f = known[w] = word_features(w)
        out.update(f)
    return np.fromiter(out, np.int32, len(out)), ratios(text, len(words))


@dataclass
class Linear:
    """A logistic model: weights of the kept hashed features, of the ratios, and of earlier categories' probabilities."""

    kept: np.ndarray
    weights: np.ndarray
    dense: np.ndarray

    def logits(self, matrix: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return matrix @ self.weights + dense @ self.dense


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def columns(rows: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    """0/1 matrix of the kept features."""
    out = np.zeros((len(rows), len(kept)), np.float32)
    if len(kept):
        for i, r in enumerate(rows):
            at = np.searchsorted(kept, r)
            at[at == len(kept)] = 0
            out[i, at[kept[at] == r]] = 1
    return out


def informative(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features whose presence says most about the label, by mutual information; sorted."""
    size, n, pos = 1 << BITS, len(y), max(1.0, y.sum())
    both = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t] or [np.empty(0, np.int32)]), minlength=size)
    seen = np.bincount(np.concatenate(rows), minlength=size)
    some = np.flatnonzero(seen >= 3)
    p, q = both[some] / n, seen[some] / n
    gain = np.zeros(len(some))
    for joint, a, b in ((p, q, pos / n), (q - p, q, 1 - pos / n), (pos / n - p, 1 - q, pos / n), (1 - q - pos / n + p, 1 - q, 1 - pos / n)):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(joint > 0, joint * np.log(joint / (a * b)), 0)
    best = np.argsort(-gain, kind="stable")[:KEEP]
    return np.sort(some[best]).astype(np.int32)


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> Linear:
    """Accelerated gradient descent on the penalised log loss; a constant model where only one class is seen."""
    if y.min() == y.max():
        constant = np.zeros(dense.shape[1])
        constant[5] = 8.0 if y[0] else -8.0
        return Linear(np.empty(0, np.int32), np.empty(0), constant)
    kept = informative(rows, y)
    x = columns(rows, kept)
    # Each feature counts by its log-likelihood ratio, so that rare but telling ones are not held back by the penalty.
    share = [np.log((x[y == t].sum(axis=0) + 1) / ((y == t).sum() + 2)) for t in (1, 0)]
    scale = np.abs(share[0] - share[1]).astype(np.float32)
    x = np.concatenate([x * scale, dense.astype(np.float32)], axis=1)
    w = ahead = np.zeros(x.shape[1], np.float32)
    # The step follows from the largest curvature, by a few power iterations.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    rate = 1 / (np.linalg.norm(v) / 4 / len(y) + 1e-4)
    for step in range(1, STEPS + 1):
        grad = x.T @ ((sigmoid(x @ ahead) - y).astype(np.float32) / len(y)) + 1e-4 * ahead
        new = ahead - rate * grad
        ahead, w = new + (step - 1) / (step + 2) * (new - w), new
    return Linear(kept, (w[: len(kept)] * scale).astype(np.float64), w[len(kept) :].astype(np.float64))


def fit_chain(rows: list[np.ndarray], dense: np.ndarray, labels: dict[str, np.ndarray]) -> Chain:
    chain, fold = Chain(list(labels)), np.arange(len(rows)) % FOLDS
    for i, y in enumerate(labels.values()):
        if not len(rows):
            chain.models.append(Linear(np.empty(0, np.int32), np.empty(0), np.r_[np.zeros(5), -8.0, np.zeros(i)]))
            continue
        chain.models.append(fit_linear(rows, dense, y))
        if i + 1 == len(labels):
            break
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            rest, here = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(rest) and len(here):
                model = fit_linear([rows[j] for j in rest], dense[rest], y[rest])
                out[here] = sigmoid(model.logits(columns([rows[j] for j in here], model.kept), dense[here]))
        dense = np.c_[dense, out]
    return chain


class Scorer:
    """Chain probabilities of single texts, with a bounded table of words' summed weights."""

    def __init__(self, chain: Chain, most: int = 100_000):
        self.chain, self.most = chain, most
        self.at = np.unique(np.concatenate([m.kept for m in chain.models]))
        self.weights = np.zeros((len(self.at), len(chain.models)))
        for k, m in enumerate(chain.models):
            self.weights[np.searchsorted(self.at, m.kept), k] = m.weights
        self.row = {f: i for i, f in enumerate(self.at.tolist())}
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> list[float]:
        words, hit, known, row = WORD.findall(text.lower()), set(), self.known, self.row
        for w in set(words):
            if (f := known.get(w)) is None:
                if len(known) > self.most:
                    known.clear()
                f = known[w] = tuple(row[x] for x in word_features(w) if x in row)
            if f:
                hit.update(f)
        total = self.weights[list(hit)].sum(axis=0) if hit else np.zeros(len(self.chain.models))
        dense, out = list(ratios(text, len(words))), []
        for k, m in enumerate(self.chain.models):
            logit = float(total[k] + np.dot(dense, m.dense))
            out.append(float(sigmoid(np.array(logit))))
            dense.append(out[-1])
        return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain (low_quality, toxic) on at most ``max_rows`` labelled documents.

    Labels without an identifier, a document or a value of ``toxic`` do not count; a null quality counts as good. Of labels that
    share an identifier the worst counts, of documents that do the one with the least text.
    """
    pick = labels.where(F.col("toxic").isNotNull()).select(F.col(id_col).alias("id"), (F.coalesce(F.col("quality"), F.lit(1)) == 0).alias("low_quality"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    pick = pick.groupBy("id").agg(F.max("low_quality").alias("low_quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most max_rows rows are broadcast, and as many come back: of documents that share an identifier one is taken.
    joined = texts.join(F.broadcast(pick), "id").groupBy("id", "low_quality", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text"):
            known: dict[str, list[int]] = {}
            made = [text_features(t.as_py() or "", known) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["id", "low_quality", "toxic", "f", "r"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = joined.mapInArrow(run, f"id {kind}, low_quality boolean, toxic boolean, f array<int>, r array<double>").toArrow()
    order = np.argsort(np.array([zlib.crc32(str(i).encode()) for i in got["id"].to_pylist()], np.int64), kind="stable").tolist()
    rows = [got["f"][i].values.to_numpy() for i in order]
    dense = np.array([got["r"][i].as_py() for i in order], np.float64).reshape(-1, 6)
    return fit_chain(rows, dense, {c: np.array(got[c].to_pylist(), np.float64)[order] if order else np.empty(0) for c in ("low_quality", "toxic")})


def score_toxicity(docs: DataFrame, chain: Chain, columns_kept: Sequence[str] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns and, per category of the chain, its probability ``p_<category>``, and ``toxic``: at least ``threshold``.

    Null and empty texts are scored as texts without words. One row per input row, repeated or not; an empty table gives an
    empty result. A chain without training rows, or with one class, gives constant probabilities. Whole texts are scored,
    however long. Other columns are ignored; a kept one must not have the name of one that is made. A kept text goes to Python once.
    """
    if clash := {*(f"p_{n}" for n in chain.names), "toxic"} & set(columns_kept):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]
    kept = [docs.schema[c] for c in columns_kept]
    once = list(columns_kept).count(text_col) == 1 and docs.schema[text_col].dataType == StringType()
    scored = text_col if once else "_scored_text"
    given = [F.col(c) for c in columns_kept] + ([] if once else [F.col(text_col).cast("string").alias(scored)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in spans(batches, scored):
            p = np.array([scorer.score(t.as_py() or "") for t in batch.column(scored)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=[*(f.name for f in kept), *names, "toxic"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names), "toxic boolean"])
    return docs.select(*given).mapInArrow(run, schema)
