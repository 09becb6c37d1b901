"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents. Words that labelled toxic documents have far more often than the others become the labelled tokens
of a bounded sample; the field is trained on them. Its states are `toxic` and `other`; its features are the token and the
tokens beside it, hashed, and the beginnings of the token. Forward-backward marginals of every token of every document give spans with their offsets, and
the highest and the summed marginals give the document's score, calibrated on the sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch
from .quality import labelled
from .textnp import LOWER, Texts, U, in_parts, mix

#: Hashed features of tokens, and the most labelled documents that training looks at.
FEATURE_BITS, SAMPLE = 20, 2500
FEATURES = 1 << FEATURE_BITS
#: Bytes of the beginnings of words that are features too, for stems that take many endings.
BEGINNINGS = (3, 4, 5, 6)
#: A feature may be a seed if SEEDS_IN toxic documents of the sample have it. It is one if it is so many deviations and so many times the odds
#: commoner in them than in the other documents of its kind; so many seeds tell a toxic document. The sample itself tells which demands are made.
SEEDS_IN, SEED_DEVIATIONS, SEED_ODDS, SEED_TOKENS = 3, (4.0, 6.0, 9.0), (3.0, 6.0, 12.0, 30.0), (1, 2, 3)
#: Kinds of documents that are told apart, by the commonest words of the sample.
KINDS, COMMON = 8, 256
SPAN_AT, SEGMENT = 0.5, 256
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of letter runs, the features of each (a row: the word and its beginnings, in lower case), and the position of each document's first."""
    starts, ends = texts.runs(_LETTER[texts.data])
    out = np.full((len(starts), 1 + len(BEGINNINGS)), FEATURES, np.int32)  # FEATURES: no such feature
    out[:, 0] = texts.hashes(starts, ends, LOWER) >> U(64 - FEATURE_BITS)
    for k, n in enumerate(BEGINNINGS, 1):
        some = ends - starts >= n
        out[some, k] = mix(texts.hashes(starts[some], starts[some] + n, LOWER) + U(n)) >> U(64 - FEATURE_BITS)
    return starts, ends, out, texts.counts(starts)


def marginals(odds: np.ndarray, at: np.ndarray, move: np.ndarray, start: float, pairs: np.ndarray | None = None, stay: np.ndarray | None = None) -> np.ndarray:
    """P(toxic) of each token by forward-backward over the two states; to ``pairs`` (2x2) the expected number of each transition is added.

    ``stay`` gets, for each token, the log of the probability that it is not toxic if the one before it is not: their sum over a document
    is that of having no toxic token.

    odds: log-odds of the toxic state of each token; move: 2x2 transition scores; start: log-odds at the first token.
    Messages are kept as odds, which two states need alone. Documents are cut into segments that go side by side; each starts
    so many tokens early and ends so many late that what a message forgets there is below rounding: a step shrinks the
    distance of two messages by tanh(d / 4), where d is the log of the transitions' cross ratio.
    """
    lengths = np.diff(at)
    shrink = math.tanh(abs(move[0, 0] + move[1, 1] - move[0, 1] - move[1, 0]) / 4)
    warm = min(int(lengths.max(initial=0)), math.ceil(math.log(1e-14) / math.log(max(shrink, 1e-3)))) if shrink < 1 else int(lengths.max(initial=0))
    n_cut = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), n_cut)
    core = at[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(n_cut) - n_cut, n_cut))
    first, last = np.maximum(at[doc], core - warm), np.minimum(at[doc + 1], core + SEGMENT + warm)
    out, e = np.zeros(len(odds)), np.exp(move)
    x_all = np.exp(np.clip(odds, -30, 30))
    order = np.argsort(first - last, kind="stable")
    for i in range(0, len(order), 1024):
        rows = order[i : i + 1024]
        width = int((last[rows] - first[rows]).max())
        col = np.arange(width)
        inside = col[None, :] < (last[rows] - first[rows])[:, None]
        where = (first[rows][:, None] + col[None, :])[inside]
        grid = np.ones((len(rows), width))
        grid[inside] = x_all[where]
        x = np.ascontiguousarray(grid.T)
        fore = np.empty_like(x)
        fore[0] = r = x[0] * np.where(first[rows] == at[doc[rows]], math.exp(start), 1.0)
        for t in range(1, width):
            fore[t] = r = x[t] * (e[0, 1] + r * e[1, 1]) / (e[0, 0] + r * e[1, 0])
        back, live = np.ones(len(rows)), np.ascontiguousarray(inside.T)
        for t in range(width - 1, -1, -1):
            fore[t] *= back
            if stay is not None:
                here = first[rows] + t
                own = live[t] & (here >= core[rows]) & (here < core[rows] + SEGMENT)
                begins = (here == at[doc[rows]])[own]
                stay[here[own]] = -np.log1p(back[own] * x[t][own] * np.where(begins, math.exp(start), e[0, 1] / e[0, 0]))
            if t:
                y = back * x[t]
                if pairs is not None:
                    here = first[rows] + t
                    own = live[t] & (here >= core[rows]) & (here < core[rows] + SEGMENT)  # a core's first token has the one before it in the warm-up
                    r, y_own = fore[t - 1][own], y[own]
                    joint = np.stack([np.full(len(r), e[0, 0]), e[0, 1] * y_own, r * e[1, 0], r * e[1, 1] * y_own])
                    pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
                back = np.where(live[t], (e[1, 0] + y * e[1, 1]) / (e[0, 0] + y * e[0, 1]), 1.0)
        p = (fore / (1 + fore)).T
        own = inside & (first[rows][:, None] + col >= core[rows][:, None]) & (first[rows][:, None] + col < core[rows][:, None] + SEGMENT)
        out[(first[rows][:, None] + col[None, :])[own]] = p[own]
    return out


@dataclass
class Model:
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    move: np.ndarray
    start: float
    final: np.ndarray

    def odds(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = self.own[f].sum(1) + self.bias
        if len(f) > 1:
            first, last = np.zeros(len(f), bool), np.zeros(len(f), bool)
            first[at[:-1][at[:-1] < len(f)]] = True
            last[at[1:][at[1:] > 0] - 1] = True
            out[1:] += np.where(first[1:], 0.0, self.before[f[:-1, 0]])
            out[:-1] += np.where(last[:-1], 0.0, self.after[f[1:, 0]])
        return out

    def marginals(self, f: np.ndarray, at: np.ndarray, pairs: np.ndarray | None = None, stay: np.ndarray | None = None) -> np.ndarray:
        return marginals(self.odds(f, at), at, self.move, self.start, pairs, stay)

    def scores(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(aggregates(p, at) @ self.final)))


def aggregates(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each document: 1, its highest marginal, and the log of one more than its tokens that are likelier toxic than not."""
    out = np.zeros((len(at) - 1, 3))
    out[:, 0] = 1
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some, 1] = np.maximum.reduceat(p, at[some])
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p > SPAN_AT, p, 0), at[some]))
    return out


def unlike(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One document of each group of near copies, which would count a rare word of theirs many times: those whose three smallest word hashes
    in one of two sets of orders are the same."""
    some = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros(len(at) - 1, bool)
    if not len(some):
        return out
    word, alone = f[:, 0].astype(U), np.ones(len(some), bool)
    for k in range(2):
        least = [np.minimum.reduceat(mix(word + U(1 << (FEATURE_BITS + 3 * k + j))), at[some]) for j in range(3)]
        first = np.zeros(len(some), bool)
        first[np.unique(np.stack(least, 1), axis=0, return_index=True)[1]] = True
        alone &= first
    out[some[alone]] = True
    return out


def kinds(f: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A number for each document's kind: documents that share their common words, which those of one language do.

    Spherical k-means over the commonest words of the sample, begun at documents as far apart as can be; of equally far ones the first.
    """
    word = f[:, 0]
    common = np.argsort(-np.bincount(word, minlength=FEATURES + 1), kind="stable")[:COMMON]
    column = np.full(FEATURES + 1, -1)
    column[common] = np.arange(len(common))
    at = column[word]
    x = np.zeros((n, len(common)), np.float32)
    np.add.at(x, (doc[at >= 0], at[at >= 0]), 1)
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres, near = [int(np.argmax(x @ x.mean(0)))], np.full(n, -1.0)
    while len(centres) < min(KINDS, n):
        near = np.maximum(near, x @ x[centres[-1]])
        centres.append(int(np.argmin(np.where(x.any(1), near, 2.0))))
    c = x[centres]
    for _ in range(20):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == k].sum(0) for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return own


def evidence(bad: np.ndarray, good: np.ndarray, n_bad: np.ndarray, n_good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much commoner features are in toxic documents than in others of their kind: deviations (of Cochran, Mantel and Haenszel) and odds.

    bad, good: documents of each kind (a row) that have a feature; n_bad, n_good: all of each kind.
    """
    nb, ng = n_bad[:, None].astype(float), n_good[:, None].astype(float)
    n, m = np.maximum(nb + ng, 2), bad + good
    spread = nb * ng * m * (n - m) / (n * n * (n - 1))
    over = (bad - m * nb / n).sum(0) / np.sqrt(spread.sum(0) + 0.1)
    return over, ((bad * (ng - good) / n).sum(0) + 0.05) / ((good * (nb - bad) / n).sum(0) + 0.05)


def seeds(f: np.ndarray, doc: np.ndarray, toxic: np.ndarray, counted: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, int]:
    """Whether a hashed feature marks toxic documents, and how many seeds tell one. Of several demands those are made that, put to one half
    of the sample, find the toxic documents of the other best, as much in rare kinds of documents as in common ones."""
    n, size = len(toxic), int(kind.max(initial=0)) + 1
    half = np.arange(n) % 2
    own = [np.unique(doc.astype(np.int64) * (FEATURES + 1) + column) for column in f.T]  # which document has which feature
    in_bad = sum(np.bincount((u % (FEATURES + 1))[(toxic & counted)[u // (FEATURES + 1)]], minlength=FEATURES + 1) for u in own)
    in_bad[FEATURES] = 0
    some = np.flatnonzero(in_bad >= SEEDS_IN)
    place = np.full(FEATURES + 1, -1)
    place[some] = np.arange(len(some))
    cell = (half * 2 + toxic) * size + kind
    found = np.zeros(4 * size * max(1, len(some)))
    for u in own:
        d, w = u // (FEATURES + 1), place[u % (FEATURES + 1)]
        use = (w >= 0) & counted[d]
        found += np.bincount(cell[d[use]] * max(1, len(some)) + w[use], minlength=len(found))
    found = found.reshape(2, 2, size, -1)
    all_docs = np.bincount(cell[counted], minlength=4 * size).reshape(2, 2, size)
    proof = [evidence(found[h, 1], found[h, 0], all_docs[h, 1], all_docs[h, 0]) for h in (0, 1)]
    at = place[f]  # of each token's features
    judged = [k for k in range(size) if (toxic & (kind == k)).sum() >= 5]
    best = (-1.0, 0.0, 0.0, 0)
    for deviations in SEED_DEVIATIONS:
        for odds in SEED_ODDS:
            n_seeds = np.zeros(n)
            for h in (0, 1):
                mark = np.r_[(proof[h][0] >= deviations) & (proof[h][1] >= odds) & (found[h, 1].sum(0) >= SEEDS_IN), False]  # the last: no feature
                n_seeds += np.bincount(doc[mark[at].any(1) & (half[doc] != h)], minlength=n)
            for least in SEED_TOKENS:
                hit = n_seeds >= least
                quality = [2 * (hit & toxic & (kind == k)).sum() / max(1, (hit & (kind == k)).sum() + (toxic & (kind == k)).sum()) for k in judged]
                best = max(best, (float(np.mean(quality)) if quality else 0.0, odds, deviations, least))
    over, odds = evidence(found[:, 1].sum(0), found[:, 0].sum(0), all_docs[:, 1].sum(0), all_docs[:, 0].sum(0))
    out = np.zeros(FEATURES + 1, bool)
    out[some] = ((over >= best[2]) & (odds >= best[1]))[: len(some)]
    return out, max(1, best[3])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton's method; x has few columns."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + l2 * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fitted(f: np.ndarray, at: np.ndarray, tag: np.ndarray, some: np.ndarray, passes: int, rate: float, l2: float) -> Model:
    """Fits the field by adaptive gradient steps: to the tags of documents that have them, and to those of ``some`` having a toxic token or more.

    The latter's gradient is the difference of two marginals: that of a token, given that one at least is toxic, and the plain one.
    """
    model = Model(np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), -4.0, np.zeros((2, 2)), 0.0, np.zeros(3))
    doc = np.repeat(np.arange(len(some)), np.diff(at))
    first = np.zeros(len(f), bool)
    first[at[:-1][at[:-1] < len(f)]] = True
    inner, loose = ~first[1:], some[doc]
    tagged = ~loose[1:] & inner
    squares, more = [np.zeros(FEATURES + 1) for _ in range(3)], np.zeros(6)
    known = np.searchsorted(np.flatnonzero(~loose), at)  # tokens of documents with tags come apart for the transitions
    fk, y = f[~loose], tag.astype(float)
    for _ in range(passes):
        pairs, stay = np.zeros((2, 2)), np.zeros(len(f))
        p = model.marginals(f, at, None, stay)
        model.marginals(fk, known, pairs)
        none = np.exp(np.add.reduceat(np.r_[stay, 0.0], np.minimum(at[:-1], len(stay))) * (np.diff(at) > 0))
        g = np.where(loose, -p * np.minimum(none / np.maximum(1 - none, 1e-6), 1e3)[doc], p - y)
        g = np.maximum(g, -1.0)
        parts = [(model.own, f, g), (model.before, f[:-1, 0][inner], g[1:][inner]), (model.after, f[1:, 0][inner], g[:-1][inner])]
        for k, (weights, at_f, grad) in enumerate(parts):
            total = l2 * weights
            for column in at_f.reshape(len(at_f), -1).T:
                total += np.bincount(column, grad, FEATURES + 1)
            total[FEATURES] = 0
            squares[k] += total * total
            weights -= rate * 2 * total / np.sqrt(squares[k] + 1e-8) * (total != 0)
        ya, yb = y[:-1][tagged], y[1:][tagged]
        steps = [g[~loose].sum(), pairs[1, 1] - (ya * yb).sum(), pairs[1, 0] - (ya * (1 - yb)).sum(), pairs[0, 1] - ((1 - ya) * yb).sum(), g[first & ~loose].sum()]
        for k, total in enumerate(steps):
            more[k] += total * total
            step = 0.2 * total / math.sqrt(more[k] + 1e-8)
            if k == 0:
                model.bias -= step
            elif k == 4:
                model.start -= step
            else:
                model.move[[(1, 1), (1, 0), (0, 1)][k - 1]] -= step
    return model


def train(texts: list[str], labels: list[int], counts: dict[int, int], passes: int = 12, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Fits the field to the seeds' tags and to toxic documents without them, then calibrates document scores."""
    toxic = np.array(labels) == 1
    parts = [tokens(t)[2:] for _, t in in_parts(texts)]
    f, counted = np.concatenate([p[0] for p in parts]), np.concatenate([np.diff(p[1]) for p in parts])
    at, n = np.r_[0, np.cumsum(counted)], len(texts)
    model = field_of(f, at, toxic, passes, rate, l2)
    # what a field gives for the documents that it has learned from says too much: each half is judged by the field of the other
    gathered, half = np.zeros((n, 3)), np.arange(n) % 2
    for h in (0, 1):
        (own, cut), (other, cut_other) = (parted(f, at, half == k) for k in (h, 1 - h))
        gathered[half != h] = aggregates(field_of(own, cut, toxic[half == h], passes, rate, l2).marginals(other, cut_other), cut_other)
    drawn = {k: max(1, int((toxic == (k == 1)).sum())) for k in counts}
    weights = np.array([counts[k] / drawn[k] for k in labels])
    model.final = logistic(gathered, toxic.astype(float), weights / weights.mean(), 0.01)
    return model


def parted(f: np.ndarray, at: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the documents in use, and where each begins."""
    return f[np.repeat(use, np.diff(at))], np.r_[0, np.cumsum(np.diff(at)[use])]


def field_of(f: np.ndarray, at: np.ndarray, toxic: np.ndarray, passes: int, rate: float, l2: float) -> Model:
    """The field that documents teach: its seeds are chosen, toxic documents with too few of them have a toxic token somewhere."""
    n, counted = len(toxic), np.diff(at)
    doc = np.repeat(np.arange(n, dtype=np.int32), counted)
    if not toxic.any():
        return Model(np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), -4.0, np.zeros((2, 2)), 0.0, np.zeros(3))
    mark, least = seeds(f, doc, toxic, unlike(f, at), kinds(f, doc, n))
    tag = mark[f].any(1) & toxic[doc]
    some = toxic & (np.bincount(doc[tag], minlength=n) < least) & (counted > 0)
    return fitted(f, at, tag, some, passes, rate, l2)


def tagger(shared, with_spans: bool):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = Texts(batch.column(1)), shared.value
        starts, ends, f, at = tokens(texts)
        if model is None:
            p, score = np.zeros(len(f)), np.zeros(texts.n)
        else:
            p = model.marginals(f, at)
            score = model.scores(p, at)
        cols, names = [batch.column(0), pa.array(score)], ["id", "score"]
        hot = p > SPAN_AT
        n_hot = np.diff(np.r_[0, np.cumsum(hot)][at])
        if with_spans:
            # offsets in characters: the bytes before a span that do not continue a character
            whole = np.r_[0, np.cumsum((texts.data & 0xC0) != 0x80)]
            spans: list[list[dict]] = [[] for _ in range(texts.n)]
            doc = np.searchsorted(at, np.flatnonzero(hot), side="right") - 1
            for d, k in zip(doc.tolist(), np.flatnonzero(hot).tolist(), strict=True):
                base = whole[texts.offsets[d]]
                spans[d].append({"start": int(whole[starts[k]] - base), "end": int(whole[ends[k]] - base), "p": float(p[k])})
            cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            names.append("spans")
        cols.append(pa.array(n_hot.astype(np.int64)))
        names.append("n_spans")
        return pa.RecordBatch.from_arrays(cols, names)

    return per_batch(one, "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int | None = 3, held: int = 1, bound: int = SAMPLE) -> Model | None:
    """A model of labelled rows; of one id with several labels the larger counts. None without labelled documents."""
    rows, counts = labelled(docs, labels, label_col, folds, held, bound)
    return train([r["text"] for r in rows], [r["label"] for r in rows], counts) if rows else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(doc_id, score, n_spans) of each row's whole text; with_spans adds spans, an array of (start, end, p) in characters.

    Null and empty texts have no tokens and get the score of a document without toxic words; without a model all score 0.
    Repeated rows and null ids are returned as they come; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = "spans array<struct<start: long, end: long, p: double>>, " * with_spans
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(tagger(shared, with_spans), f"id long, score double, {spans}n_spans long").withColumnRenamed("id", id_col)
