"""Two tokenizers over the same bytes: the shortest groups of tokens that cover the same text, and which ids stand together.

The texts of an Arrow batch are one run of bytes with the documents' offsets beside it. The token ends of both tokenizers are
counted by offset once; where both have one, the text is cut. Sums over the run, taken at the documents' offsets, give each
document's numbers without a loop over documents.

How often two ids are linked in the whole corpus is one row for each pair. Two linked ids end at the same byte, so the bytes of
one are the end of the other's: there are no more such pairs than the vocabularies have bytes (``most_pairs``), and the table
may be sent to all workers, whatever the corpus.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch
from .packing import byte_signs
from .textnp import Texts

#: Bytes of text whose tokens a worker aligns at once; one longer text is taken whole.
AT_ONCE = 1 << 18
GROUPS = "groups array<struct<a: array<int>, b: array<int>>>"
ALIGNED = f"doc_id long, n_a long, n_b long, {GROUPS}, link_a array<int>, link_b array<int>"


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the files: A's vocabulary and merges, the same as ranks, and B's model."""

    a: str
    a_ranks: str
    b: str


class Spelled:
    """The bytes of each token of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts, self.pool = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, files: Tokenizers):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(files.a, encoding="utf-8") as f:
            whole = json.load(f)
        signs = {s: b for b, s in byte_signs().items()}
        a = {i: bytes(signs[x] for x in s) for s, i in whole["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in whole["added_tokens"]}
        self.a = Spelled([a.get(i, b"") for i in range(max(a) + 1)])
        self.files = files
        with open(files.a_ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.space = self.model.piece_to_id("▁")
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.b = Spelled([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces])

    @cached_property
    def library(self):
        """A's own tokenizer, which only some texts need."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.files.a)
        found.encode_special_tokens = True
        return found

    def most_pairs(self) -> int:
        """No more pairs of ids than these can end together: of each token the ends, of which B may spell one byte twice, as itself and as <0xHH>."""
        return int(2 * self.a.lengths.sum() + self.b.lengths.sum())

    def whole(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B, each text by the libraries as a whole."""
        return [self.library.encode(" " + t, add_special_tokens=False).ids for t in texts], self.model.encode(texts, num_threads=1)

    def units(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of words with what stands before them, which begin with a space. The ranks give A the ids of the file, sooner."""
        b = self.model.encode([u[1:] for u in units], num_threads=1)
        return [self.ranked.encode_ordinary(u) for u in units], [x or [self.space] for x in b]  # the model adds no space to nothing


class Known:
    """Both encodings of the units that a worker has met: texts repeat their words, so few units are encoded."""

    def __init__(self, pair: Pair, limit: int = 1 << 17, ids: int = 1 << 21):
        self.pair, self.limit, self.ids = pair, limit, ids
        # a unit ends before a space behind a sign that is none; A's pattern always parts there, B's merges if no piece of it has one inside
        self.apart = not pair.model.is_unknown(pair.space) and not any(re.search("[^▁]▁", pair.model.id_to_piece(i)) for i in range(pair.model.get_piece_size()))
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.a, self.b = Pool(), Pool()

    def encoded(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A and B of all units, and how many each unit has."""
        if len(self.slots) > self.limit or self.b.used > self.ids:
            self.clear()
        keys, at, of = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        slots = np.array([-1 if x is None else x for x in map(self.slots.get, keys.tolist())], np.int64)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            data = texts.data.tobytes()
            a, b = self.pair.units([data[i:j].decode() for i, j in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)])
            self.a.add(a)
            self.b.add(b)
            slots[fresh] = np.arange(len(fresh)) + len(self.slots)
            self.slots.update(zip(keys[fresh].tolist(), slots[fresh].tolist(), strict=True))
        slots = slots[of]
        return *self.a.ids_of(slots), *self.b.ids_of(slots)


class Pool:
    """Lists of ids one after the other, which grow together."""

    def __init__(self):
        self.starts, self.counts, self.ids, self.n, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0, 0

    def add(self, lists: list[list[int]]) -> None:
        ids, counts = flat(lists)
        n, used = self.n + len(counts), self.used + len(ids)
        if n > len(self.starts):
            self.starts, self.counts = (np.resize(x, 2 * n) for x in (self.starts, self.counts))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.starts[self.n : n], self.counts[self.n : n] = self.used + np.cumsum(counts) - counts, counts
        self.ids[self.used : used] = ids
        self.n, self.used = n, used

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists with these numbers, and how many each has."""
        n = self.counts[slots]
        return self.ids[np.repeat(self.starts[slots] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


@lru_cache(maxsize=2)
def pair_of(files: Tokenizers) -> Pair:
    return Pair(files)


@lru_cache(maxsize=2)
def known_of(files: Tokenizers) -> Known:
    return Known(pair_of(files))


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each has."""
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


#: Classes of bytes that begin the signs of plain texts: up to U+04FF, and general punctuation to mathematical signs.
_PLAIN = np.ones(256, bool)
_PLAIN[0xD4:] = False
_PLAIN[0xE2] = True
#: A text with a longer run of white space goes by the libraries, whose pattern takes it in one step.
RUN = 500


def plain_texts(texts: Texts) -> np.ndarray:
    """Which texts have only letters and signs that every version of Unicode of the last ten years tells alike, and no endless white space."""
    data = texts.data
    bad = ~_PLAIN[data]
    bad[:-1] |= (data[:-1] == 0xE2) & (data[1:] >= 0xB0)
    starts, ends = texts.runs(data <= 32)
    bad[starts[ends - starts > RUN]] = True
    sums = np.r_[0, np.cumsum(bad)]
    return sums[texts.offsets[1:]] == sums[texts.offsets[:-1]]


def same_bytes(spelled: Spelled, ids: np.ndarray, of: np.ndarray, want: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents' tokens, joined, are the bytes that they should be; want holds those of document i at at[i]:at[i+1]."""
    n = len(at) - 1
    good = np.bincount(of, spelled.lengths[ids], n).astype(np.int64) == np.diff(at)
    some = good[of]
    where = np.repeat(good, np.diff(at))
    wrong = np.zeros(len(want), bool)
    wrong[where] = spelled.bytes_of(ids[some]) != want[where]
    sums = np.r_[0, np.cumsum(wrong)]
    return good & (sums[at[1:]] == sums[at[:-1]])


def ids_of(known: Known, spaced: Texts, docs: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A's ids, the document of each, B's ids and theirs. ``docs`` numbers the texts, which begin with their space."""
    data, n = spaced.data, len(spaced.data)
    quick = plain & known.apart
    first = np.zeros(n, bool)
    first[1:] = (data[1:] == 32) & ~((data[:-1] == 32) | ((data[:-1] >= 9) & (data[:-1] <= 13)))
    first[spaced.offsets[:-1]] = True
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], n].astype(np.int64)
    of = np.repeat(np.arange(spaced.n), np.diff(spaced.counts(starts)))
    some = quick[of]
    a, n_a, b, n_b = known.encoded(spaced, starts[some], ends[some])
    of_a, of_b = np.repeat(of[some], n_a), np.repeat(of[some], n_b)
    rest = np.flatnonzero(~quick)
    if len(rest):
        cut = spaced.offsets
        lists_a, lists_b = known.pair.whole([data[cut[i] + 1 : cut[i + 1]].tobytes().decode() for i in rest.tolist()])
        (more_a, n_a), (more_b, n_b) = flat(lists_a), flat(lists_b)
        # in the order of texts again
        a, b, of_a, of_b = np.r_[a, more_a], np.r_[b, more_b], np.r_[of_a, np.repeat(rest, n_a)], np.r_[of_b, np.repeat(rest, n_b)]
        order_a, order_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
        a, b, of_a, of_b = a[order_a], b[order_b], of_a[order_a], of_b[order_b]
    return a, docs[of_a], b, docs[of_b]


def groups_of(known: Known, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """n_a, n_b, groups and the linked ids of both for each text of a column."""
    pair, texts = known.pair, Texts(column)
    n = texts.n
    # a text with its space; empty ones have none
    sizes = np.diff(texts.offsets)
    full = np.flatnonzero(sizes > 0)
    at = np.zeros(n + 1, np.int64)
    at[1:] = np.cumsum(sizes + (sizes > 0))
    want = np.full(at[-1], 32, np.uint8)
    place = np.ones(at[-1], bool)
    place[at[full]] = False
    want[place] = texts.data
    spaced = Texts(pa.array([], pa.large_string()))
    spaced.data, spaced.offsets, spaced.n = want, np.r_[at[full], at[-1]], len(full)
    a, of_a, b, of_b = ids_of(known, spaced, full, plain_texts(texts)[full])
    good = (sizes > 0) & same_bytes(pair.a, a, of_a, want, at) & same_bytes(pair.b, b, of_b, want, at)
    a, b, of_a, of_b = a[good[of_a]], b[good[of_b]], of_a[good[of_a]], of_b[good[of_b]]

    # the run of bytes of the good documents, and the tokens' ends in it
    at = np.zeros(n + 1, np.int64)
    at[1:] = np.cumsum(np.where(good, sizes + 1, 0))
    end_a, end_b = np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b])
    both = np.bincount(end_a, minlength=at[-1] + 1) * np.bincount(end_b, minlength=at[-1] + 1)
    cut = both > 0
    per_doc = np.cumsum(cut)[at]  # cuts up to each document's end; no token ends at 0
    last_a, last_b = np.flatnonzero(cut[end_a]), np.flatnonzero(cut[end_b])
    lists = lambda ids, last: pa.ListArray.from_arrays(pa.array(np.r_[0, last + 1].astype(np.int32)), pa.array(ids))
    inner = pa.StructArray.from_arrays([lists(a, last_a), lists(b, last_b)], ["a", "b"])
    per_text = pa.array(per_doc.astype(np.int32))
    by_text = lambda values: pa.ListArray.from_arrays(per_text, values)
    return np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), by_text(inner), by_text(pa.array(a[last_a])), by_text(pa.array(b[last_b]))


def group_digests(groups: pa.ListArray) -> pa.Array:
    """The sha256 of each document's groups as text: the ids of A joined by commas, a bar, those of B; groups joined by semicolons. '' for no groups."""
    inner = groups.flatten()
    (a, at_a), (b, at_b) = ((x.values.to_numpy(), x.offsets.to_numpy().astype(np.int64)) for x in (inner.field("a"), inner.field("b")))
    a, b, at_a, at_b = a[at_a[0] : at_a[-1]], b[at_b[0] : at_b[-1]], at_a - at_a[0], at_b - at_b[0]
    n = len(inner)
    # A's ids of a group stand behind B's of the groups before, B's behind A's of this one; each with the sign that follows it
    place_a, place_b = np.arange(len(a)) + np.repeat(at_b[:-1], np.diff(at_a)), np.arange(len(b)) + np.repeat(at_a[1:], np.diff(at_b))
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a], code[place_b] = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
    if n:
        code[place_a[at_a[1:] - 1]] += 1
        code[place_b[at_b[1:] - 1]] += 2
    signs = decimals(int(code.max(initial=0)) // 3 + 1)
    cut = (at_a + at_b)[groups.offsets.to_numpy() - groups.offsets[0].as_py()]
    texts = (b"".join(map(signs.__getitem__, code[i:j].tolist()))[:-1] for i, j in pairwise(cut.tolist()))
    return pa.array([sha256(t).hexdigest() if t else "" for t in texts], pa.string())


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[bytes]:
    return [f"{i}{sign}".encode() for i in range(n) for sign in ",|;"]


def decimals(n: int) -> list[bytes]:
    """Each number with each of three signs behind it; for more numbers than asked for, so that one list serves."""
    return _decimals(1 << max(16, n.bit_length()))


def aligned(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Callable[[pa.ListArray], pa.Array]] | None = None) -> DataFrame:
    """Each document's tokens of A and B in groups that cover the same bytes, as short as they can be.

    Returns doc_id, n_a, n_b, groups (in order; the ids of A and of B) and, for each place where tokens of both end, their ids as
    link_a and link_b. A encodes a space and the text, B the text, to which it adds the space itself; special tokens are plain
    text. A null or empty text, and one whose tokens do not spell it (B writes a space for the sign U+2581), has no tokens. Rows
    stay as they come, with null ids and repeats; other columns are dropped. With ``derive``, n_groups and strings made out of the
    groups in the task come in their place: names, and what makes the strings of a column of groups.
    """
    derive = derive or {}

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_a, n_b, groups, link_a, link_b = groups_of(known_of(files), batch.column(1))
        made = {"n_groups": groups.value_lengths().cast(pa.int64()), **{name: g(groups) for name, g in derive.items()}} if derive else {"groups": groups}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_a": pa.array(n_a.astype(np.int64)), "n_b": pa.array(n_b.astype(np.int64)), **made, "link_a": link_a, "link_b": link_b})

    schema = ALIGNED.replace(GROUPS, ", ".join(["n_groups long", *[f"{name} string" for name in derive]])) if derive else ALIGNED
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(per_batch(f, "text", limit=AT_ONCE), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n): how often the two ids are linked in all documents; counted in the tasks first."""
    return rows.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("link")).groupBy("link.link_a", "link.link_b").agg(F.count("*").alias("n")).select(F.col("link_a").alias("a"), F.col("link_b").alias("b"), "n")


def scored(rows: DataFrame, counts: DataFrame, files: Tokenizers, row: str = "row") -> DataFrame:
    """Adds n_best, the links whose pair is linked as often as any of its B id in the corpus, and count_sum, over all links; link_a and link_b go.

    ``counts`` is what ``pair_counts`` gives for the same rows, written, as it is read more than once; ``row`` tells rows apart. The
    counts are sent to all workers; more pairs than the two vocabularies can have raise an error. Links meet their counts as they are
    taken out of their row, and are summed in the task first.
    """
    most = pair_of(files).most_pairs()
    if (found := counts.count()) > most:
        raise ValueError(f"{found} pairs are more than the {most} that these tokenizers can link")
    highest = counts.groupBy("b").agg(F.max("n").alias("most")).withColumnRenamed("b", "of")
    told = counts.join(highest, F.col("b") == F.col("of")).select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    links = rows.select(row, F.explode(F.arrays_zip("link_a", "link_b")).alias("link")).select(row, "link.*")
    met = links.join(F.broadcast(told), (F.col("link_a") == F.col("a")) & (F.col("link_b") == F.col("b")))
    sums = met.groupBy(F.col(row).alias("_row")).agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    out = rows.drop("link_a", "link_b").join(sums, F.col(row) == F.col("_row"), "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
