"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word bucket has a sparse random index vector; a bucket's context vector is the sum of the index vectors of the
words beside it over all documents. Words count twice, as their letters and as their shape (case, last sign, length).
A document is the mean of its words' unit context vectors, for letters and shapes apart. The network is trained in
numpy on a bounded sample of labelled documents and its temperature is set on a part of that sample held back.

Context sums are integers: every task adds up its own table of fixed size (`buckets` x `dims`), and Spark sums the
tables by bucket range. The finished table has a fixed size and travels with the tasks; scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.textblock import Words, blocks, mix
from tapeworks.llm.toxicity import fold

_U = np.uint64
_SLICES = 32


def index_vectors(buckets: int, dims: int, ones: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    h = mix(np.arange(buckets * ones, dtype=np.uint64).reshape(buckets, ones) + _U(77))
    return (h % _U(dims)).astype(np.int64), ((h >> _U(63)).astype(np.int64) * 2 - 1)


def word_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Letter bucket (lower half) and shape bucket (upper half) of each word of a block."""
    half = _U(buckets // 2)
    raw, low = words.raw, words.raw | 32
    letter = (((low >= 97) & (low <= 122)) | (raw >= 128)).astype(np.int64)
    upper = ((raw >= 65) & (raw <= 90)).astype(np.int64)
    total, caps = np.concatenate(([0], np.cumsum(letter))), np.concatenate(([0], np.cumsum(upper)))
    n, u = total[words.ends] - total[words.starts], caps[words.ends] - caps[words.starts]
    last = raw[words.ends - 1].astype(np.int64)
    sign = np.where(letter[words.ends - 1] > 0, 0, last)
    case = np.where(u == 0, 0, np.where((u == n) & (n > 1), 2, 1))
    length = np.minimum(words.ends - words.starts, 24) // 3
    shape = ((sign * 4 + case) * 16 + length) * 2 + (n == 0)
    hashed = Words.__new__(Words)
    hashed.raw, hashed.inside = np.where(upper > 0, low, raw), words.inside
    hashed.starts, hashed.ends, hashed.first = words.starts, words.ends, words.first
    return (hashed.hashes() % half).astype(np.int64), (half + mix(shape.astype(np.uint64) + _U(5)) % half).astype(np.int64)


def context_table(docs: DataFrame, text_col: str, buckets: int, dims: int, ones: int) -> np.ndarray:
    """Context sums of all documents: buckets x dims."""
    step = buckets // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(buckets, dims, ones)
        total = np.zeros(buckets * dims, np.int64)
        seen = False
        for batch in batches:
            for _, _, raw, offs in blocks(batch.column(0), 2 << 20):
                words = Words(raw, offs)
                if not len(words):
                    continue
                seen = True
                w, s = word_buckets(words, buckets)
                row = words.rows()
                beside = row[1:] == row[:-1]
                a, b = np.flatnonzero(beside), np.flatnonzero(beside) + 1
                for x, y in ((w[a], w[b]), (w[b], w[a]), (s[a], s[b]), (s[b], s[a]), (w, s), (s, w)):
                    for k in range(ones):
                        total += np.bincount(x * dims + place[y, k], sign[y, k], buckets * dims).astype(np.int64)
        if seen:
            table = total.reshape(_SLICES, step * dims).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES)), pa.array([x.tobytes() for x in table], pa.binary())], ["slice", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step * dims, np.int64)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_buffer(), "<i8")
        return pa.table({"slice": table.column("slice").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slice long, sums binary").groupBy("slice").applyInArrow(add, "slice long, sums binary")
    out = np.zeros((_SLICES, step * dims), np.int64)
    for row in parts.collect():  # fixed size: buckets x dims numbers in all
        out[row["slice"]] = np.frombuffer(row["sums"], "<i8")
    return out.reshape(buckets, dims)


def unit_rows(table: np.ndarray) -> np.ndarray:
    size = np.sqrt((table.astype(float) ** 2).sum(1, keepdims=True))
    return (table / np.maximum(size, 1)).astype(np.float32)


def pooled(raw: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean letter and shape vectors of each text of a block, and the logarithm of its words."""
    n, dims = len(offs) - 1, vectors.shape[1]
    out = np.zeros((n, 2 * dims + 1), np.float32)
    words = Words(raw, offs)
    if not len(words):
        return out
    w, s = word_buckets(words, len(vectors))
    count = np.diff(words.first)
    full = np.flatnonzero(count)
    for k, ids in enumerate((w, s)):
        out[full, k * dims : (k + 1) * dims] = np.add.reduceat(vectors[ids], words.first[full], axis=0) / count[full, None]
    out[:, -1] = np.log1p(count) / 8
    return out


class Network:
    """Inputs scaled, one hidden tanh layer, a logistic output divided by a temperature."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.sd, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.p = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh((x - self.mean) / self.sd @ a + b) @ c + d[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> None:
        """Adam on the log loss; the last fifth sets the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        own, back = order[: len(x) - len(x) // 5], order[len(x) - len(x) // 5 :]
        self.mean = np.average(x[own], 0, n[own])
        self.sd = np.sqrt(np.average((x[own] - self.mean) ** 2, 0, n[own])) + 1e-3
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        epochs = max(5, min(epochs, 400_000 // max(len(own), 1) + 5))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
                z = (x[at] - self.mean) / self.sd
                h = np.tanh(z @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3][0], -30, 30))) - y[at]) * n[at] / n[at].sum()
                dh = np.outer(e, self.p[2]) * (1 - h * h)
                t += 1
                for i, g in enumerate((z.T @ dh, dh.sum(0), h.T @ e, np.array([e.sum()]))):
                    g = g + decay * self.p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(back):
            z, s = self.logits(x[back]), 2 * y[back] - 1
            grid = np.geomspace(0.25, 8, 60)
            self.temperature = float(grid[np.argmin([np.average(np.logaddexp(0, -s * z / k), weights=n[back]) for k in grid])])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, buckets: int = 8192, dims: int = 64, ones: int = 2, fit_rows: int = 20_000, limit: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted (score >= limit) of every row.

    The network learns from at most `fit_rows` labelled rows (labels: id_col, quality) outside the held-out fold, those
    with the least hashes of their ids; an id whose labels clash counts as 0. Word vectors come from all rows' texts. A
    null or empty text is the zero vector; a very long one is pooled whole. Rows without an id are held out. Without labels of both kinds every score is the labels' share of 1, or 0.5.
    An empty table gives an empty table; repeated rows stay; other columns play no part.
    """
    vectors = unit_rows(context_table(docs, text_col, buckets, dims, ones))
    marks = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("double").alias("y")).where("_id is not null and y is not null").where(fold("_id", folds) != held)
    marks = marks.groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(1)):
                x = pooled(raw, offs, vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_doc"), text.alias("text"))
    sample = rows.join(F.broadcast(marks), F.col("_doc") == F.col("_id")).select("y", "text").mapInArrow(features, "y double, x binary")
    sample = sample.groupBy("x", "y").agg(F.count("*").alias("n"))  # rows of equal features and label are one weighted row
    sample = sample.orderBy(F.xxhash64("x"), "x", "y").limit(2 * fit_rows).collect()  # in an order free of the features' size and of the label
    y, n = np.array([r["y"] for r in sample]), np.array([float(r["n"]) for r in sample])
    net = Network(2 * dims + 1)
    constant = None
    if len(set(y.tolist())) > 1:
        net.fit(np.stack([np.frombuffer(r["x"], np.float32) for r in sample]).astype(float), y, n)
    else:
        constant = float(np.average(y, weights=n)) if len(y) else 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(1)):
                p = net.probabilities(pooled(raw, offs, vectors).astype(float)) if constant is None else np.full(b - a, constant)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], ["_doc", "score"])

    kind = rows.schema["_doc"].dataType.simpleString()
    out = rows.mapInArrow(score, f"_doc {kind}, score double")
    out = out.select(F.col("_doc").alias(id_col), F.coalesce(fold("_doc", folds) == held, F.lit(True)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))
