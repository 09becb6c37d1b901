"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained on the driver with follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled rows;
n-grams are of one to four characters (code points in lower case; what is no letter is a space). A temperature fitted on part of the sample calibrates the scores. Only the model, whose size is fixed by GRAMS and the
number of languages, is broadcast.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import per_batch, remainder
from .learning import sampled
from .textnp import Texts, U, in_parts, mix

#: Bits of the dimensions of hashed n-grams, the lengths of these in characters, and the most rows of labelled text that training looks at.
GRAM_BITS, LENGTHS, SAMPLE = 17, (1, 2, 3, 4), 2000
GRAMS = 1 << GRAM_BITS


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter or a mark that belongs to one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in lower case, what is no letter as a space, and where each text begins."""
    lowered = Texts(pc.utf8_lower(pa.LargeStringArray.from_buffers(texts.n, pa.py_buffer(texts.offsets), pa.py_buffer(texts.data))))
    points = np.frombuffer(lowered.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.r_[0, np.cumsum((lowered.data & 0xC0) != 0x80)][lowered.offsets]
    return np.where(letters()[points], points, np.uint32(32)), begins


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count), sorted, of n-grams of characters that are not all spaces."""
    c, begins = characters(texts)
    doc = np.repeat(np.arange(texts.n, dtype=np.int64), np.diff(begins))
    keys = []
    for n in LENGTHS:
        if len(c) < n:
            continue
        code, some = np.full(len(c) - n + 1, n, U), np.zeros(len(c) - n + 1, bool)
        for k in range(n):
            part = c[k : len(c) - n + 1 + k]
            code = code * U(0x9E3779B97F4A7C15) + part.astype(U)
            some |= part != 32
        inside = some & (doc[: len(code)] == doc[n - 1 :])
        keys.append(doc[: len(inside)][inside] * GRAMS + (mix(code[inside]) >> U(64 - GRAM_BITS)).astype(np.int64))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head] // GRAMS, keys[head] % GRAMS, np.diff(np.r_[head, len(keys)])


def weighed(texts: Texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1, as (document, n-gram, weight)."""
    doc, gram, count = grams(texts)
    w = (1 + np.log(count)) * idf[gram]
    norm = np.sqrt(np.bincount(doc, w * w, texts.n))
    return doc, gram, w / norm[doc]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: Texts) -> np.ndarray:
        doc, gram, w = weighed(texts, self.idf)
        out = np.tile(self.bias, (texts.n, 1))
        for k in range(len(self.languages)):
            out[:, k] += np.bincount(doc, w * self.weights[gram, k], texts.n)
        return out


def train(texts: list[str], languages: list[str], alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5, passes: int = 4) -> Model:
    """FTRL-proximal over the rows in their order; every fifth row is held back for the temperature."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    back = np.arange(len(y)) % 5 == 4
    if back.all() or len(set(y[~back])) < len(names):
        back[:] = False
    df, n_texts = np.zeros(GRAMS), len(texts)
    for _, t in in_parts(texts):
        df += np.bincount(grams(t)[1], minlength=GRAMS)
    model = Model(names, np.zeros((GRAMS, len(names))), np.zeros(len(names)), np.log((1 + n_texts) / (1 + df)) + 1)
    parts, sizes = [], []
    for _, t in in_parts(texts):
        doc, gram, w = weighed(t, model.idf)
        parts.append((gram.astype(np.int32), w.astype(np.float32)))
        sizes.append(np.bincount(doc, minlength=t.n))
    gram, w = (np.concatenate([p[k] for p in parts]) for k in range(2))
    at = np.r_[0, np.cumsum(np.concatenate(sizes))]
    del parts
    z, n = np.zeros((GRAMS + 1, len(names))), np.zeros((GRAMS + 1, len(names)))
    order = np.flatnonzero(~back)
    for turn in range(passes):
        for i in np.random.default_rng(turn).permutation(order):
            g = np.r_[gram[at[i] : at[i + 1]], GRAMS]  # the last is the bias
            x = np.r_[w[at[i] : at[i + 1]], 1.0][:, None]
            zi, ni = z[g], n[g]
            v = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax((v * x).sum(0))
            p[y[i]] -= 1
            grad = x * p
            sigma = (np.sqrt(ni + grad * grad) - np.sqrt(ni)) / alpha
            z[g] = zi + grad - sigma * v
            n[g] = ni + grad * grad
    v = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    model.weights, model.bias = v[:-1], v[-1]
    logits = np.concatenate([model.logits(t) for _, t in in_parts(texts)])[back if back.any() else slice(None)]
    truth = y[back] if back.any() else y

    def loss(temperature: float) -> float:
        return -np.log(np.maximum(1e-12, softmax(logits / temperature)[np.arange(len(truth)), truth])).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def has_letters(texts: Texts, column: pa.Array) -> np.ndarray:
    plain = ((texts.data | 32) >= 97) & ((texts.data | 32) <= 122)
    sums = np.r_[0, np.cumsum(plain)]
    out = sums[texts.offsets[1:]] > sums[texts.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


def scorer(shared, text: str):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, column = shared.value, batch.column(text)
        texts = Texts(column)
        if model is None:
            best, score, known = np.zeros(texts.n, int), np.zeros(texts.n), np.zeros(texts.n, bool)
            names = [""]
        else:
            p = softmax(model.logits(texts) / model.temperature)
            best, score, known, names = p.argmax(1), p.max(1), has_letters(texts, column), model.languages
        score = np.where(known, score, 0.0)
        told = pa.array([names[k] if ok else "und" for k, ok in zip(best, known, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, told, pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return per_batch(f, text)


def fit(docs: DataFrame, folds: int | None = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE) -> Model | None:
    """A model of rows with a non-null language and text; with ``folds``, of those only whose crc32(id) modulo folds is not 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    if folds:
        rows = rows.where(remainder("id", folds) != 0)
    some, _ = sampled(rows, "lang", "id", bound)
    got = sorted(some.collect(), key=lambda r: (r["id"], r["lang"], r["text"]))
    if not got:
        return None
    order = np.random.default_rng(5).permutation(len(got))
    return train([got[i]["text"] for i in order], [got[i]["lang"] for i in order])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row; `und` with score 0 where the text is null or has no letter, or no language was learned.

    Whole texts count. Repeated rows and null ids are returned as they come; other columns are not looked at.
    """
    return with_language(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), model, text_col).drop(text_col)


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with lang_pred and score as ``predict`` tells them, without a shuffle; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    told = StructType([*kept.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(scorer(shared, text_col), told)
