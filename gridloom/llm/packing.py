"""Best-fit decreasing packing of tokenized documents into sequences.

Lengths are whole numbers up to the capacity, so equal lengths can be placed together: the fit runs over the histogram of
lengths (at most ``capacity`` numbers, whatever the corpus) with a segment tree over remaining capacities that finds the
tightest open bin in logarithmic time. Its outcome is a list of runs: the items of one length with ranks a..b go to bins
s..s+(b-a) at one offset. Items get their rank within their length by salted counts, and look up their run by bisection.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, large_text, per_batch
from .textnp import Texts

#: Rows of one length that share a rank counter, on average; a more common length has several counters.
RANKED_TOGETHER = 1000


class Fit:
    """Best-fit decreasing over a histogram of lengths. Runs are (length, first rank, count, first bin, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, bool)  # whether a bin is open with a remaining capacity in the node's range
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> (first bin, count)
        self.bins, self.runs = 0, []

    def _mark(self, room: int) -> None:
        k, there = room + self.size, bool(self.open[room])
        self.tree[k] = there
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least length."""
        k = length + self.size
        while not self.tree[k]:
            while k & 1:  # up from right children, then to the sibling on the right
                k //= 2
            if k < 1:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        return k - self.size

    def place(self, length: int, count: int) -> None:
        rank = 0
        while rank < count:
            room = self.tightest(length)
            if room is None:
                # new bins take as many of this length as fit, one bin after the other
                each = self.capacity // length
                full, rest = divmod(count - rank, each)
                for k in range(each):
                    if full:
                        self.runs.append((length, rank, full, self.bins, k * length))
                        rank += full
                if full:
                    self._add(self.capacity - each * length, self.bins, full)
                    self.bins += full
                for k in range(rest):
                    self.runs.append((length, rank, 1, self.bins, k * length))
                    rank += 1
                if rest:
                    self._add(self.capacity - rest * length, self.bins, 1)
                    self.bins += 1
                return
            first, n = self.open[room].pop()
            # the tightest bin stays the tightest until it cannot take another item
            each = min(room // length, 1 << 30)
            left = count - rank
            full = min(n, left // each)
            for k in range(each):
                if full:
                    self.runs.append((length, rank, full, first, self.capacity - room + k * length))
                    rank += full
            rest = (left - full * each) if full < n else 0
            for k in range(rest):
                self.runs.append((length, rank, 1, first + full, self.capacity - room + k * length))
                rank += 1
            if full:
                self._add(room - each * length, first, full)
            if rest:
                self._add(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            if used < n:
                self.open[room].append((first + used, n - used))
            self._mark(room)

    def _add(self, room: int, first: int, n: int) -> None:
        if room:
            self.open[room].append((first, n))
            self._mark(room)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first bin, offset), sorted by length and rank, and the number of bins."""
    fit = Fit(capacity)
    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        fit.place(length, counts[length])
    runs = np.array(fit.runs, np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))], fit.bins


# fixed values: the contractions that the vocabulary file splits off before it splits letters, single digits and other signs
SHORT = {"'s", "'t", "'m", "'d", "'re", "'ve", "'ll"}
#: Classes of bytes in texts that take the quick path: space, letter, digit, other, and bytes that no such text has.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[33:127] = 3
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xC6] = 1  # two-byte letters from U+00C0 to U+017F
_NOT_LETTERS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]  # the signs of multiplication and division; a letter that two letters replace


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Vocabulary:
    """Token ids of whole columns of text: each distinct piece meets the library's merges once in a worker."""

    def __init__(self, path: str, limit: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.signs = Tokenizer.from_file(path), limit, byte_signs()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.begin, self.length, self.pool, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def ids_of(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.signs))]

    def hold(self, keys: list[int], lists: list[list[int]]) -> np.ndarray:
        """Keeps the ids of new pieces; their slots."""
        counts = np.array([len(x) for x in lists], np.int64)
        first, n, used = len(self.slots), len(self.slots) + len(lists), self.used + int(counts.sum())
        if n > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * n), np.resize(self.length, 2 * n)
        if used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * used)
        self.begin[first:n], self.length[first:n] = self.used + np.cumsum(counts) - counts, counts
        self.pool[self.used : used] = np.fromiter(chain.from_iterable(lists), np.uint32, used - self.used)
        self.slots.update(zip(keys, range(first, n), strict=True))
        self.used = used
        return np.arange(first, n)

    def documents(self, column: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text, then end_id."""
        texts = Texts(column)
        kinds = _CLASS[texts.data]
        odd = kinds == 4
        for a, b in _NOT_LETTERS:
            odd[:-1] |= (texts.data[:-1] == a) & (texts.data[1:] == b)
        before = np.r_[0, np.cumsum(odd)]
        quick = before[texts.offsets[1:]] == before[texts.offsets[:-1]]
        for token in self.added:  # texts that hold one are the library's whole
            quick &= ~np.asarray(pc.match_substring(column, token, ignore_case=True).fill_null(False))
        out: list = [None] * texts.n
        some = np.flatnonzero(quick)
        if len(some):
            for i, ids in zip(some.tolist(), self.quick(large_text(column).take(pa.array(some)), end_id), strict=True):
                out[i] = ids
        for i in np.flatnonzero(~quick).tolist():
            out[i] = np.array([*self.odd(column[i].as_py() or ""), end_id], "<u4")
        return out

    def odd(self, text: str) -> list[int]:
        """The ids of a text that does not take the quick path."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def quick(self, column: pa.Array, end_id: int) -> list[np.ndarray]:
        texts = Texts(pc.utf8_lower(column))
        data, n = texts.data, len(texts.data)
        kinds = _CLASS[data]
        first = np.ones(n, bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        first[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
        if len(quotes := np.flatnonzero((data == 39) & first)):
            stop = texts.offsets[np.searchsorted(texts.offsets, quotes, side="right")]
            for q, e in zip(quotes.tolist(), stop.tolist(), strict=True):
                for k in (2, 3):
                    if q + k <= e and bytes(data[q : q + k]).decode("latin-1") in SHORT:
                        first[q + 1 : q + k] = False
                        if q + k < n:
                            first[q + k] = True
                        break
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], n].astype(np.int64)
        real = kinds[starts] != 0
        starts, ends = starts[real], ends[real]
        if len(self.slots) > self.limit:
            self.clear()
        keys, at, of = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        slots = np.array([-1 if x is None else x for x in map(self.slots.get, keys.tolist())], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            whole = data.tobytes()
            slots[new] = self.hold(keys[new].tolist(), [self.ids_of(whole[i:j]) for i, j in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        slot = slots[of] if len(of) else np.zeros(0, np.int64)
        lengths = self.length[slot]
        # one more id, the end, after the last piece of each document
        cut = texts.counts(starts)
        lengths_and_ends = np.insert(lengths, cut[1:], 1)
        source = np.insert(self.begin[slot], cut[1:], -1)
        begin = np.r_[0, np.cumsum(lengths_and_ends)]
        index = np.repeat(source - begin[:-1], lengths_and_ends) + np.arange(begin[-1])
        ends_at = begin[cut[1:] + np.arange(texts.n)]
        index[ends_at] = 0
        flat = self.pool[index]
        flat[ends_at] = end_id
        return np.split(flat, ends_at[:-1] + 1)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, piece, start, length, crc, tokens = [], [], [], [], [], []
        for i, got in zip(batch.column(0).to_pylist(), vocabulary_of(path).documents(batch.column(1), end_id), strict=True):
            for k in range(0, len(got), capacity):
                part = got[k : k + capacity]
                ids.append(i)
                piece.append(k // capacity)
                start.append(k)
                length.append(len(part))
                crc.append(zlib.crc32(part.astype("<u4", copy=False).data))
                if with_ids:
                    tokens.append(part.astype(np.int32))
        cols = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols, names = [*cols, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    return per_batch(f, "text")


def looked_up(shared):
    """Adds sequence_id and offset to pieces that have a rank within their length."""

    def run(batches):
        runs, order = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(order, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), side="right") - 1
            got = runs[at]
            kept = [n for n in batch.schema.names if n not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(got[:, 3] + rank - got[:, 1]), pa.array(got[:, 4])], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each takes.

    A document is its token ids and then ``end_id``; only documents longer than ``capacity`` are cut, into pieces of that
    length and a last one that may be shorter. Returns doc_id, piece (from 0), start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), sequence_id (from 0) and offset; with ``with_ids`` also ids, the tokens. Null and
    empty texts are the end id alone. Rows with a null id are packed under a null doc_id; repeated rows are packed as often
    as they come. Other columns are dropped. An empty table gives no rows. The same rows give the same sequences in number,
    not always the same numbers.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = scratch.keep(docs.mapInArrow(pieces(tokenizer, capacity, end_id, with_ids), schema))

    # ranks: a salt has about RANKED_TOGETHER rows of a length, and each salt starts where the one before it ends
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shares = F.create_map(*[F.lit(x).cast("long") for n, c in counts.items() if c > RANKED_TOGETHER for x in (n, -(-c // RANKED_TOGETHER))]) if any(c > RANKED_TOGETHER for c in counts.values()) else None
    n_salts = F.coalesce(F.element_at(shares, F.col("length")), F.lit(1)) if shares is not None else F.lit(1)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), n_salts))
    by_salt = cut.groupBy("length", "salt").count()
    before = by_salt.select(F.col("length").alias("l"), F.col("salt").alias("s"), (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("l", "s", "before", "nth", "salt")

    runs, _ = best_fit_decreasing(counts, capacity)
    # the runs follow the histogram, which has at most ``capacity`` lengths, not the corpus
    shared = spark.sparkContext.broadcast((runs, (runs[:, 0].astype(np.uint64) << np.uint64(48)) + runs[:, 1].astype(np.uint64)))
    return ranked.mapInArrow(looked_up(shared), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame, end_id: int = 1) -> DataFrame:
    """The token ids of each sequence, out of pieces packed ``with_ids``: at most ``capacity`` ids a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
