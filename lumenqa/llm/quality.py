"""Quality classifier: a factorisation machine over hashed words, text structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in
linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is fitted on the driver from at most ``max_rows`` labelled rows (a documented bound,
chosen by a hash of the id); scoring reads every whole text on the executors with the fixed-size
model as a broadcast.  Labels, language, source and id are never inputs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, crc_fold, map_rows, tidied, written

WORD_BITS = 15
#: One-hot slots of the structure statistics and of the metadata come after the hashed words.
BINS, STATS = 16, 12
SIZE = (1 << WORD_BITS) + BINS * STATS
MAX_ROWS = 6000
THRESHOLD = 0.3
#: The driver takes the training rows in the order of a hash until their features fill so many bytes.
MAX_BYTES = 256 << 20
#: Documents are scored together until they have so many features, or a batch ends.
SCORED_FEATURES = 100_000


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << WORD_BITS) - 1)


def _share(x: float) -> int:
    return min(BINS - 1, int(x * BINS))


def _log(x: float) -> int:
    return min(BINS - 1, int(math.log2(x + 1)))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one whole text; null reads as empty."""
    text = text or ""
    raw = text.split()
    counts = Counter(text.lower().split())
    n, chars = max(1, len(raw)), max(1, len(text))
    letters = len(text) - sum(map(text.count, " \n\t"))
    upper = sum(1 for w in raw if w.isupper())
    lines = text.split("\n")
    marked = sum(1 for w in raw if not w[-1].isalnum() and w[-1] not in ".,;:")
    single = sum(1 for c in counts.values() if c == 1)
    most = max(counts.values(), default=0)
    stats = [
        _log(len(raw)), _share(letters / n / 20), _share(upper / n), _share(marked / n), _share(len(counts) / n), _share(single / n),
        _share(most / n), _log(len(lines)), _share(len(set(lines)) / len(lines)), _share(sum(map(text.count, "0123456789")) / chars * 4),
        _share(sum(map(text.count, ".,")) / n), 0 if n_chars is None else _log(max(0, n_chars)),
    ]
    words = np.fromiter(map(_slot, counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = np.sqrt((values * values).sum()) or 1.0
    at = (1 << WORD_BITS) + np.arange(STATS) * BINS + np.array(stats)
    return np.concatenate([words, at]), np.concatenate([values / norm, np.full(STATS, 0.5)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; row k has the features from starts[k] on (never none)."""
        return 1 / (1 + np.exp(-np.clip(self.raw(index, values, starts)[0], -30, 30)))

    def raw(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weighted = self.factors[index] * values[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted * weighted, starts, axis=0)
        line = np.add.reduceat(self.linear[index] * values, starts)
        return self.bias + line + 0.5 * (sums * sums - squares).sum(axis=1), sums


def _ragged(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 4, epochs: int | None = None, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss.  Without rows, or with one label only, the prior is the score."""
    epochs = epochs or min(40, max(12, 40_000 // max(1, len(rows))))  # few rows are seen more often
    rng = np.random.default_rng(seed)
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    m = Machine(math.log(prior / (1 - prior)), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, rank)))
    if not len(labels) or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    g_line, g_fac, g_bias = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            index, values, starts = _ragged([rows[i] for i in pick])
            raw, sums = m.raw(index, values, starts)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]
            row = np.repeat(np.arange(len(pick)), np.diff([*starts, len(index)]))
            each = error[row] * values / len(pick)
            used, back = np.unique(index, return_inverse=True)
            line = np.bincount(back, each, len(used)) + decay * m.linear[used]
            inner = each[:, None] * (sums[row] - m.factors[index] * values[:, None])
            fac = np.stack([np.bincount(back, inner[:, k], len(used)) for k in range(rank)], axis=1) + decay * m.factors[used]
            g_line[used] += line * line
            g_fac[used] += fac * fac
            m.linear[used] -= rate * line / np.sqrt(g_line[used])
            m.factors[used] -= rate * fac / np.sqrt(g_fac[used])
            g_bias += float(error.mean()) ** 2
            m.bias -= rate * float(error.mean()) / math.sqrt(g_bias)
    return m


#: Training ids are taken in neighbourhoods of so many and looked for in so many ranges, so that a scan
#: in the order of ids can skip most of a large table.
NEIGHBOURS, RANGES = 64, 128


def _ranges(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ids, cut at the widest gaps."""
    ids = sorted(set(ids))
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    starts = sorted([0, *gaps])
    return [(ids[a], ids[b - 1]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def _any(tests: list[Column]) -> Column:
    """A balanced or, as deep as the logarithm of its parts."""
    return tests[0] if len(tests) == 1 else _any(tests[: len(tests) // 2]) | _any(tests[len(tests) // 2 :])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 5) -> DataFrame:
    """(doc_id, text, n_chars, label): at most ``max_rows`` labelled rows outside the held-out fold.

    Neighbourhoods of ids are taken in the order of a hash, until there are enough rows.  Ids
    labelled both ways, null ids and null labels are left out; repeated labels count once.
    """
    whole = labels.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    clean = labels.filter(F.col("quality").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != 0))
    once = clean.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    place = F.xxhash64(F.floor(F.col("doc_id") / NEIGHBOURS)) if whole else F.xxhash64("doc_id")
    picked = once.orderBy(place, "doc_id").limit(max_rows).select("doc_id", "label").collect()  # at most max_rows
    rows = docs.select("doc_id", "text", "n_chars")  # other columns may have any name
    if not picked:
        return rows.limit(0).withColumn("label", F.lit(0))
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in picked], f"`__id` {labels.schema['doc_id'].dataType.simpleString()}, label int")
    if whole:
        rows = rows.filter(_any([F.col("doc_id").between(a, b) for a, b in _ranges([r["doc_id"] for r in picked])]))
    return rows.join(F.broadcast(wanted), rows["doc_id"] == wanted["__id"]).select("doc_id", "text", "n_chars", "label")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, label: str = "quality", **options) -> Machine:
    """Fits the machine; features are made on the executors, the driver gets numbers only.

    It gets at most ``max_rows`` rows of ids (twice that where ids repeat) and ``max_bytes`` of
    features, in the order of a hash.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts, sizes, marks = (c.to_pylist() for c in batch.columns)
            made = [features(t, n) for t, n in zip(texts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(i) for i in ids], pa.string()), pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary()), pa.array(marks, pa.int32())],
                ["doc_id", "index", "value", "label"],
            )

    made = training_rows(docs, labels, max_rows).mapInArrow(tidied(run), "doc_id string, index binary, value binary, label int")
    made = written(made, label)
    got, size = [], 0
    for r in made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("index", "value")).toLocalIterator():  # a partition at a time
        size += len(r["index"]) + len(r["value"])
        if size > max_bytes or len(got) == 2 * max_rows:
            break
        got.append(r)
    rows = [(np.frombuffer(r["index"], "<u4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in got]
    return fit(rows, np.array([r["label"] for r in got], float), **options)


def _scored(machine: Machine, texts: pa.Array, sizes: pa.Array) -> np.ndarray:
    """The scores of a batch; features of a few documents at a time are held, however long they are."""
    out, held, size = [np.zeros(0)], [], 0
    for text, n in zip(texts, sizes, strict=True):
        held.append(features(text.as_py(), n.as_py()))
        size += len(held[-1][0])
        if size > SCORED_FEATURES:
            out.append(machine.scores(*_ragged(held)))
            held, size = [], 0
    if held:
        out.append(machine.scores(*_ragged(held)))
    return np.concatenate(out)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """(doc_id, score): one row per row of ``docs``; null and empty texts are scored like others."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        m = Machine(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(m, batch.column(1), batch.column(2)))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(size_col).cast("long").alias("n"))
    return rows.mapInArrow(tidied(run), f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null id is not held out.  An empty table gives an empty result; without usable labels the
    score is a constant 0.5.
    """
    scored = score(docs, train(docs, labels, max_rows))
    held = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the machine does not reject, all columns as they were, in one pass.

    Rows are scored as by :func:`score`; repeated rows stay or go together, and an empty table gives
    an empty result.
    """
    machine = train(docs, labels, max_rows, label=label)
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))
    text_at, size_at = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches: Batches) -> Batches:
        m = Machine(*shared.value)
        for batch in batches:
            good = _scored(m, batch.column(text_at), batch.column(size_at).cast(pa.int64())) >= threshold
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_rows(docs, run, [])


__all__ = ["Machine", "classify", "features", "fit", "keep_good", "score", "train", "training_rows"]
