"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are words and runs of other signs, and pairs of neighbours, hashed. TF-IDF rows of a bounded labelled sample are reduced by
a singular value decomposition; a few measures of repetition and make-up stand beside its axes. The labelled vectors, at most
SAMPLE of them, are broadcast. Every document meets all of them in exact blocked cosine products, and its nearest neighbours
vote with weights that grow with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, remainder
from .learning import sampled
from .textnp import BYTES, Texts, U, in_parts, mix

#: Labelled documents, axes of the space, neighbours that vote, and hashed terms.
SAMPLE, LATENT, NEIGHBOURS, TERMS = 3000, 48, 65, 1 << 13
#: How much all measures weigh beside all axes.
MEASURED = 0.5
# kinds of bytes: space, of a word, other
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_low:_high] = 1


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words and of runs of other signs, and the document of each."""
    kind = _KIND[texts.data]
    words, signs = texts.runs(kind == 1), texts.runs(kind == 2)
    starts, ends = np.r_[words[0], signs[0]], np.r_[words[1], signs[1]]
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return starts, ends, texts.hashes(starts, ends, BYTES), np.searchsorted(texts.offsets, starts, side="right") - 1


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count), sorted, of hashed tokens and pairs of neighbouring tokens."""
    _, _, h, doc = tokens(texts)
    pair = mix(h[:-1] * U(3) + h[1:])[doc[:-1] == doc[1:]] if len(h) else h
    of = np.r_[doc, doc[:-1][doc[:-1] == doc[1:]]] if len(h) else doc
    keys = np.sort(of * TERMS + (np.r_[h, pair] % U(TERMS)).astype(np.int64))
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head] // TERMS, keys[head] % TERMS, np.diff(np.r_[head, len(keys)])


def weighed(texts: Texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1, as (document, term, weight)."""
    doc, term, count = terms(texts)
    w = ((1 + np.log(count)) * idf[term]).astype(np.float32)
    norm = np.sqrt(np.bincount(doc, w * w, texts.n))
    return doc, term, w / norm[doc].astype(np.float32)


def measures(texts: Texts) -> np.ndarray:
    """How a document repeats itself and what it is made of, a row for each: repeated tokens and runs of four, signs for words, length."""
    starts, _, h, doc = tokens(texts)
    n = np.maximum(1, np.bincount(doc, minlength=texts.n))
    four = h[:-3] + U(3) * h[1:-2] + U(5) * h[2:-1] + U(7) * h[3:] if len(h) > 3 else h[:0]
    inside = doc[: len(four)] == doc[3:] if len(h) > 3 else np.zeros(0, bool)

    def repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, of))
        k, d = keys[order], of[order]
        return np.bincount(d[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])], minlength=texts.n) / n

    signs = np.bincount(doc[_KIND[texts.data[starts]] == 2], minlength=texts.n) / n
    return np.stack([repeated(h, doc), repeated(four[inside], doc[: len(four)][inside]), signs, np.log1p(n) / 10], 1)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    shares: np.ndarray

    def projected(self, texts: Texts) -> np.ndarray:
        doc, term, w = weighed(texts, self.idf)
        out = np.zeros((texts.n, self.axes.shape[1]), np.float32)
        if len(doc):
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[doc[head]] = np.add.reduceat(self.axes[term] * w[:, None], head)
        return out

    def latent(self, texts: Texts) -> np.ndarray:
        z = self.projected(texts)
        z = (z - self.mean[: z.shape[1]]) / self.scale[: z.shape[1]]
        m = np.clip((measures(texts) - self.mean[z.shape[1] :]) / self.scale[z.shape[1] :], -4, 4)
        out = np.concatenate([z, m * np.sqrt(MEASURED * z.shape[1] / m.shape[1])], 1)
        return (out / np.maximum(1e-12, np.sqrt((out * out).sum(1, keepdims=True)))).astype(np.float32)

    def score(self, texts: Texts, neighbours: int = NEIGHBOURS) -> np.ndarray:
        q, out = self.latent(texts), np.empty(texts.n)
        k = min(neighbours, len(self.labels))
        for i in range(0, texts.n, 256):
            cos = q[i : i + 256] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, 1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
            sim = np.take_along_axis(cos, near, 1)
            w = np.exp(12.0 * (sim - 1)) * self.shares[near]
            out[i : i + 256] = (w * self.labels[near]).sum(1) / np.maximum(1e-30, w.sum(1))
        return np.clip(out, 0, 1)


def train(texts: list[str], labels: list[int], counts: dict[int, int]) -> Model:
    """counts: the rows of each label in all, of which ``texts`` are a sample; votes are weighed up to them."""
    y, df = np.array(labels), np.zeros(TERMS)
    for _, t in in_parts(texts):
        df += np.bincount(terms(t)[1], minlength=TERMS)
    idf = (np.log((1 + len(y)) / (1 + df)) + 1).astype(np.float32)
    x = np.zeros((len(y), TERMS), np.float32)  # at most SAMPLE rows
    for start, t in in_parts(texts):
        doc, term, w = weighed(t, idf)
        x[start + doc, term] = w
    # the leading right singular vectors, by subspace iteration from random ones
    k = min(LATENT, len(y))
    axes = np.random.default_rng(7).normal(size=(TERMS, k + 16)).astype(np.float32)
    for _ in range(4):
        axes = x.T @ np.linalg.qr(x @ axes)[0]
    axes = np.linalg.qr(axes)[0]
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    axes = np.ascontiguousarray((axes @ turn[:k].T), np.float32)
    del x
    drawn = {k: max(1, int((y == k).sum())) for k in counts}
    shares = np.array([counts[k] / drawn[k] for k in labels])
    model = Model(idf, axes, np.zeros(0), np.zeros(0), np.zeros((0, 0)), y.astype(float), shares / shares.mean())
    both = np.concatenate([np.concatenate([model.projected(t), measures(t)], 1) for _, t in in_parts(texts)])
    model.mean, model.scale = both.mean(0), np.maximum(1e-3, both.std(0))
    # axes keep their relative spread: they are centred and scaled together
    model.scale[: axes.shape[1]] = max(1e-3, float(np.sqrt((both[:, : axes.shape[1]].var(0)).mean())))
    model.vectors = np.concatenate([model.latent(t) for _, t in in_parts(texts)])
    return model


def scorer(shared):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        score = shared.value.score(texts) if shared.value is not None else np.full(texts.n, 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return per_batch(f, "text")


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int | None, held: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, dict]:
    """At most ``bound`` (id, text, label) rows in a fixed random order, and the counts of all labels outside the held-out fold."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if folds:
        rows = rows.where(remainder("id", folds) != held)
    some, counts = sampled(rows.groupBy("id").agg(F.max("label").alias("label")), "label", "id", bound)
    texts = docs.select(F.col(id_col).cast("long").alias("of"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample has at most ``bound`` rows; of texts with one id the first in order counts
    got = texts.join(F.broadcast(some), F.col("of") == F.col("id")).groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).collect()
    got = sorted(got, key=lambda r: r["id"])
    return [got[i] for i in np.random.default_rng(3).permutation(len(got))], counts


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int | None = 3, held: int = 1, bound: int = SAMPLE) -> Model | None:
    """A model of labelled rows; of one id with several labels the larger counts. None without labelled documents."""
    rows, counts = labelled(docs, labels, label_col, folds, held, bound)
    return train([r["text"] for r in rows], [r["label"] for r in rows], counts) if rows else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row, from 0 to 1, of whole texts; null texts score as empty ones, all score 0.5 without a model.

    Repeated rows and null ids are returned as they come; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scorer(shared), "id long, score double").withColumnRenamed("id", id_col)
