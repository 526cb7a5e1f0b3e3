"""Quality classifier (7): random-indexing word vectors pooled per document, then a two-layer numpy network.

Terms are runs of letters, digits or punctuation; a term's bucket is its hash (A-Z as a-z, runs of capitals told apart). Every
bucket has a fixed sparse random index vector; a bucket's context vector is the sum of the index vectors of
the terms around it, over all documents, so it costs one pass and sums up by partition. A document is the mean
and spread of its terms' normalized vectors, and of the steps between neighbours. The network learns from a bounded sample of
labelled rows; its temperature is set on a part of them that it didn't learn from.

Texts are walked in pieces of PIECE bytes, cut at white space where there is any, so a worker's memory doesn't grow with the longest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_sizes, texts_of
from .textops import PIECE, U64, mix, run_sums

#: Words of one bucket share a vector. The README has held-out figures at several numbers of buckets.
BUCKETS = 8192
SIZE = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
#: Labelled rows that the network is fitted on at most (those whose hash is least); the statistics of words cover all documents.
MOST_LABELLED = 20_000
FEATURES = 2 * SIZE + 3

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 white space, 1 letter, 2 digit, 3 anything else
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, dtype=np.int32)
_SMALL[97:123] = 1


def index_vectors(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector."""
    draw = mix(np.arange(buckets * NONZERO, dtype=U64), 91).reshape(buckets, NONZERO)
    return (draw % U64(SIZE)).astype(np.int64), np.where((draw >> U64(40)) & U64(1), 1.0, -1.0)


def cut(text: bytes) -> Iterator[bytes]:
    """The text in pieces of less than PIECE bytes, cut behind the last white space that leaves half a piece or more, else anywhere."""
    at = 0
    while len(text) - at >= PIECE:
        end = 1 + max(text.rfind(c, at + PIECE // 2, at + PIECE - 2) for c in (b" ", b"\n", b"\t", b"\r"))
        end = end or at + PIECE - 2
        yield text[at:end]
        at = end
    yield text[at:]


def term_blocks(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, number of the text) of all terms in order, in blocks of PIECE bytes at most."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in cut(text):
            if held and size + len(piece) + 1 > PIECE:
                yield _terms(held, buckets)
                held, size = [], 0
            held.append((i, piece))
            size += len(piece) + 1
    if held:
        yield _terms(held, buckets)


def _terms(held: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(x + b"\n" for _, x in held), dtype=np.uint8)
    hashes, start, end = run_sums(raw, _KIND[raw])
    upper, small = (np.concatenate([[0], np.cumsum(of[raw], dtype=np.int32)]) for of in (_UPPER, _SMALL))
    shouted = (upper[end] - upper[start] > 1) & (small[end] == small[start])
    hashes = mix(hashes + shouted.astype(U64) * U64(0x51ED270B), 93)
    edges = np.cumsum([0] + [len(x) + 1 for _, x in held])
    of = np.repeat([i for i, _ in held], np.diff(np.searchsorted(start, edges)))
    return (hashes & U64(buckets - 1)).astype(np.int64), of


def context_sums(terms: np.ndarray, of: np.ndarray, out: np.ndarray) -> None:
    """Adds each term's neighbours' index vectors, up to REACH away within its text, to its bucket's row."""
    buckets = len(out)
    places, signs = index_vectors(buckets)
    flat = out.reshape(-1)
    for gap in range(1, REACH + 1):
        near = np.flatnonzero(of[gap:] == of[:-gap])
        pair, times = np.unique(terms[near] * buckets + terms[near + gap], return_counts=True)
        left, right = pair // buckets, pair % buckets
        for k in range(NONZERO):
            for own, other in ((left, right), (right, left)):
                flat += np.bincount(own * SIZE + places[other, k], weights=times * signs[other, k], minlength=len(flat))


def word_vectors(docs: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Normalized context vectors of all buckets over all documents (driver: one row per bucket). Sums are whole numbers, so the order of tasks doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, SIZE))
        for whole in batches:
            for batch in slices(whole, text_sizes(whole.column(0)), PIECE):
                for terms, of in term_blocks(texts_of(batch.column(0)), buckets):
                    context_sums(terms, of, total)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, buckets, 64), pa.int32()), pa.array([total[k : k + 64].astype("<i4").tobytes() for k in range(0, buckets, 64)], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(sums, dtype="<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    parts = map_arrow(docs.select(F.col(text_col).alias("text")), run, schema)
    summed = map_arrow(parts.repartition("block"), add, schema)
    vectors = np.zeros((buckets, SIZE))
    for r in summed.toLocalIterator():
        vectors[r["block"] : r["block"] + 64] = np.frombuffer(bytes(r["sums"]), dtype="<i8").reshape(64, SIZE)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of features per text; zeros for a text without terms. Steps aren't counted across the cuts of a long text."""
    sums = np.zeros((len(texts), 2 * SIZE + 2))
    n = np.zeros(len(texts))
    for terms, of in term_blocks(texts, len(vectors)):
        if not len(terms):
            continue
        rows = vectors[terms]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        own = of[first]
        step = np.zeros((len(terms), 2), dtype=np.float32)
        step[1:, 0] = (rows[1:] * rows[:-1]).sum(axis=1)
        step[1:, 1] = terms[1:] == terms[:-1]
        step[first] = 0
        sums[own, :SIZE] += np.add.reduceat(rows, first, axis=0)
        sums[own, SIZE : 2 * SIZE] += np.add.reduceat(rows * rows, first, axis=0)
        sums[own, 2 * SIZE :] += np.add.reduceat(step, first, axis=0)
        n[own] += np.diff(first, append=len(of))
    each = sums / np.maximum(n, 1)[:, None]
    mean = each[:, :SIZE]
    spread = np.sqrt(np.maximum(each[:, SIZE : 2 * SIZE] - mean * mean, 0))
    out = np.concatenate([mean, spread, each[:, 2 * SIZE :], np.log1p(n)[:, None] / 10], axis=1).astype(np.float32)
    out[n == 0] = 0
    return out


class Network:
    """tanh layer, linear layer, logistic output divided by a temperature."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, held: np.ndarray, seed: int = 5, epochs: int = 300):
        draw = np.random.default_rng(seed)
        fit = ~held if held.any() and (~held).any() and len(set(labels[~held])) > 1 else np.ones(len(labels), dtype=bool)
        self.center = rows[fit].mean(axis=0) if len(rows) else np.zeros(FEATURES)
        self.scale = (rows[fit].std(axis=0) if len(rows) else np.ones(FEATURES)) + 1e-3
        self.w1 = draw.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN))
        self.b1, self.w2, self.b2, self.temperature = np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0
        if not len(rows):
            return
        x, y = self._scaled(rows[fit]), labels[fit].astype(np.float64)
        state = [np.zeros_like(np.asarray(p, dtype=np.float64)) for p in (self.w1, self.b1, self.w2, self.b2)]
        square = [np.zeros_like(s) for s in state]
        count = 0
        for _ in range(max(20, min(epochs, 1_000_000 // len(x)))):
            order = draw.permutation(len(x))
            for at in range(0, len(x), 128):
                own = order[at : at + 128]
                h = np.tanh(x[own] @ self.w1 + self.b1)
                z = h @ self.w2 + self.b2
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                dh = np.outer(d, self.w2) * (1 - h * h)
                grads = (x[own].T @ dh + 1e-3 * self.w1, dh.sum(axis=0), h.T @ d + 1e-3 * self.w2, d.sum())
                count += 1
                for k, (name, g) in enumerate(zip(("w1", "b1", "w2", "b2"), grads, strict=True)):
                    state[k] = 0.9 * state[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * np.square(g)
                    setattr(self, name, getattr(self, name) - 0.005 * (state[k] / (1 - 0.9**count)) / (np.sqrt(square[k] / (1 - 0.999**count)) + 1e-8))
        if (~fit).any():
            z, y = self._logits(rows[~fit]), labels[~fit]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(min(grid, key=lambda t: float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t)))))

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.center) / self.scale, -8, 8)

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(rows) @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(rows) / self.temperature, -30, 30)))


def fold_of(key) -> int:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return zlib.crc32(str(key).encode()) % 5


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, label_col: str, most: int) -> Network:
    """Learns from labelled rows of folds 1 to 4; fold 1 only calibrates. At most `most` ids, those of the least hash, and one row of each."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.withColumn("fold", (F.crc32(F.col("id").cast("string").cast("binary")) % 5).cast("int")).where("fold <> 0")
    known = known.orderBy(F.xxhash64("id"), "id").limit(most)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_sizes(whole.column(3)), PIECE):
                rows = pooled(texts_of(part.column(3)), vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "label", "fold", "features"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # `most` rows of 20 bytes
    each = map_arrow(rows.select("id", "label", "fold", "text"), run, f"id {kind}, label int, fold int, features binary")
    found = each.groupBy("id").agg(F.first("label").alias("label"), F.first("fold").alias("fold"), F.min("features").alias("features")).orderBy("id").toArrow()
    features = np.array([np.frombuffer(x, dtype=np.float32) for x in found["features"].to_pylist()], dtype=np.float32).reshape(-1, FEATURES)
    return Network(features, found["label"].to_numpy(), found["fold"].to_numpy() == 1)


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, buckets: int) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs, text_col, buckets)
    return vectors, fit(docs, labels, vectors, id_col, text_col, label_col, most)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, most_labelled: int = MOST_LABELLED, buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of `docs`, all columns, whose score() reaches the threshold, so null and empty texts stay or go together; rows pass by without a join."""
    vectors, network = trained(docs, labels, id_col, text_col, label_col, most_labelled, buckets)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_sizes(whole.column(place)), PIECE):
                yield part.filter(pa.array(network(pooled(texts_of(part.column(place)), vectors)) >= threshold))

    return map_arrow(docs, run, docs.schema)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, most_labelled: int = MOST_LABELLED, buckets: int = BUCKETS,
) -> DataFrame:
    """(id, held_out, score, predicted) of each row: the chance of label 1 by the text alone, and score >= threshold.

    Ids, labels, languages and sources are never inputs of a score. Null and empty texts score as a text without
    terms; equal texts score alike; repeated rows each have a row. Labels without a document, and null labels, are
    ignored; an id with several labels counts once, with the greatest, and one with several rows by one of them. Without labels all scores come from the
    untrained network. An empty table gives no rows; further columns aren't read.
    """
    vectors, network = trained(docs, labels, id_col, text_col, label_col, most_labelled, buckets)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_sizes(whole.column(1)), PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(network(pooled(texts_of(part.column(1)), vectors)).astype(np.float64))], ["id", "score"])

    scored = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double")
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return scored.select(F.col("id").alias(id_col), F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
