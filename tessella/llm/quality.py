"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import FIT_ROWS, as_strings, labelled_rows, mix64, split_words, text_slices, word_hashes

#: Rows (hashed words) and columns of the word vectors, non-zeros of an index vector, and context on either side.
ROWS, WIDTH, NONZERO, WINDOW = 1 << 14, 32, 2, 2
#: Word vectors go to the driver in so many parts, each summed by one task.
PARTS = 16
PUNCTUATION = ".,;:!?()[]{}<>\"'#$%&*|=+-_/\\~`"


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of every row's sparse random index vector, from a hash of the row."""
    h = np.stack([mix64(np.arange(ROWS, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k + 1)) for k in range(NONZERO)], axis=1)
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def streams(texts: pa.Array):
    """Per slice of texts: first row, offsets per text, and the row of each token.

    A word is a token of its normal form; marks follow it as tokens of their own: a run of closing punctuation of two or
    more signs, capitals throughout, digits, and being the same as the word before.
    """
    for at, part in text_slices(as_strings(texts), 2 << 20):
        offsets, codes, table = split_words(part, lower=False)
        lower = pc.utf8_lower(table)
        core = pc.utf8_trim(lower, characters=PUNCTUATION)
        bare = np.asarray(pc.equal(core, ""))
        row_of = lambda a, salt: (mix64(word_hashes(a) + np.uint64(salt)) % np.uint64(ROWS)).astype(np.int64)
        tail = pc.replace_substring_regex(lower, r"^.*[^!-/:-@\[-`{-~]", "")
        marks = [
            np.where(bare, row_of(table, 1), row_of(core, 0)),
            np.where(np.asarray(pc.greater(pc.utf8_length(tail), 1)) & ~bare, row_of(tail, 2), -1),
            np.where(np.asarray(pc.utf8_is_upper(table)) & (np.asarray(pc.utf8_length(core)) > 1), 3, -1),
            np.where(np.asarray(pc.match_substring_regex(table, "[0-9]")), 4, -1),
        ]
        again = np.zeros(len(codes), dtype=bool)
        again[1:] = codes[1:] == codes[:-1]
        again[offsets[:-1][offsets[:-1] < len(codes)]] = False
        columns = np.stack([*(m[codes] for m in marks), np.where(again, 5, -1)], axis=1)
        there = columns >= 0
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
        yield at, len(part), ends[offsets], columns[there]


def context_sums(texts: pa.Array, into: np.ndarray) -> None:
    """Adds to each row the index vectors of the tokens within WINDOW of it in the same text."""
    place, sign = index_vectors()
    for _, n, offsets, tokens in streams(texts):
        doc = np.repeat(np.arange(n), np.diff(offsets))
        for step in range(1, WINDOW + 1):
            same = np.flatnonzero(doc[step:] == doc[:-step])
            left, right = tokens[same], tokens[same + step]
            for own, other in ((left, right), (right, left)):
                for k in range(NONZERO):
                    into += np.bincount(own * WIDTH + place[other, k], weights=sign[other, k], minlength=ROWS * WIDTH)


def pooled(texts: pa.Array, vectors: np.ndarray, n_rows: int) -> np.ndarray:
    """Mean word vector and log length of each text; a text without words is all zeros."""
    out = np.zeros((n_rows, WIDTH + 1))
    for at, n, offsets, tokens in streams(texts):
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        if len(full):
            sums = np.add.reduceat(vectors[tokens], offsets[:-1][full], axis=0)
            out[at + full, :WIDTH] = sums / size[full, None]
            out[at + full, WIDTH] = np.log1p(size[full]) / 8
    return out


@dataclass
class Network:
    """Two layers: tanh units, then one logistic unit, whose logit is divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, batch: int = 64, seed: int = 5) -> Network:
    """Adam on three quarters of the rows; the temperature is the one with the least log loss on the last quarter."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    if not 0 < y.sum() < len(y):
        net.w2[:] = 0
        net.b2 = 0.0 if not len(y) else (4.0 if y.all() else -4.0)
        return net
    order = rng.permutation(len(y))
    fit, held = order[len(y) // 4 :], order[: len(y) // 4]
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), batch):
            rows = fit[k : k + batch]
            h = np.tanh(z[rows] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -50, 50))) - y[rows]) / len(rows)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ err + 1e-4 * params[2], np.array([err.sum()])]
            t += 1
            for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (1 - epoch / epochs) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(params[3][0])
    logit, target = net.logit(x[held]), y[held]
    grid = np.exp(np.linspace(-1.5, 3, 91))
    loss = [np.mean(np.logaddexp(0, -np.where(target > 0, 1, -1) * logit / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2), fit_rows: int = FIT_ROWS) -> QualityModel:
    """Word vectors from every row and whole text of docs; the network from fit_rows labelled rows at most.

    labels has doc_id and label (0, 1 or null); rows of which crc32(doc_id) mod held_out[0] is held_out[1] teach nothing.
    The vectors have a fixed size (hashed words), so what is summed and sent to the driver does not depend on the vocabulary. A doc_id with several
    texts counts once, with the one of the smallest pooled vector; null ids and ids without a document teach nothing; without labels of both
    kinds every score is the same.
    """
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    width = ROWS // PARTS * WIDTH

    def sums(batches):
        total = np.zeros(ROWS * WIDTH)
        for batch in batches:
            context_sums(batch.column(0), total)
        parts = [total[k * width : (k + 1) * width].astype(np.float32).tobytes() for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(width), 0
        for batch in batches:
            part = batch.column(0)[0].as_py()
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, dtype=np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part", "sums"])

    got = text.mapInArrow(sums, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").toPandas().sort_values("part")
    raw = np.concatenate([np.zeros(0, dtype=np.float32), *(np.frombuffer(x, dtype=np.float32) for x in got["sums"])])
    vectors = (raw if len(raw) else np.zeros(ROWS * WIDTH, dtype=np.float32)).reshape(ROWS, WIDTH)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            x = pooled(batch.column(2), shared.value, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    train_rows = labelled_rows(docs, labels, id_col, text_col, held_out, fit_rows)
    rows = train_rows.mapInArrow(pool, f"doc_id {dict(train_rows.dtypes)['doc_id']}, label int, x binary").toPandas().sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float64).reshape(-1, WIDTH + 1)
    return QualityModel(vectors, train(x, rows["label"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (probability of label 1), predicted (score >= threshold) for every row.

    Null and empty texts are scored as texts without words; repeated rows get the same score; ids may be of any type; other columns are not
    read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            p = shared.value.network.probability(pooled(batch.column(1), shared.value.vectors, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return text.mapInArrow(run, f"doc_id {dict(text.dtypes)['doc_id']}, score double, predicted int")
