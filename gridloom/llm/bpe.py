"""Byte-pair encoding with the merges of a vocabulary file, and decoding.

A piece is a doubly linked list of symbols. The pairs that may merge wait in a queue by rank and place; one merge takes two
neighbours out and offers the two pairs that it makes. Entries whose symbols have changed meanwhile are skipped, so a piece of
n symbols takes n log n steps however long it is. Each distinct piece of a worker meets the merges once.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import per_batch
from .packing import Vocabulary, byte_signs

#: Bits for the place in a piece, behind the rank; the symbol that is no id, whose pairs are below those of all ids.
PLACE, MASK, GONE = 32, (1 << 32) - 1, -(1 << 40)


class Merges:
    """The ranks of pairs of ids, and what each pair becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.base = 1 + max(self.ids.values())
        self.rank: dict[int, int] = {}  # of a pair of ids, as one number
        self.into: list[int] = []  # what the pair of each rank becomes
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.ids[a] * self.base + self.ids[b]] = len(self.into)
            self.into.append(self.ids[a + b])

    def symbols(self, piece: str) -> list[int]:
        """The ids of the signs of a piece; the last one bears the mark of a word's end."""
        return [self.ids[x] for x in piece[:-1]] + [self.ids[piece[-1] + self.end]] if piece else []

    def merged(self, symbols: list[int]) -> list[int]:
        n, base, rank, into, push, pop = len(symbols), self.base, self.rank.get, self.into, heapq.heappush, heapq.heappop
        ranks = [rank(a * base + b) for a, b in pairwise(symbols)]
        queue = [r << PLACE | i for i, r in enumerate(ranks) if r is not None]
        heapq.heapify(queue)
        # the list ends in a symbol that pairs with none, as do those that a merge has taken out
        symbols, after, before = [*symbols, GONE], list(range(1, n + 2)), list(range(-1, n))
        while queue:
            top = pop(queue)
            i, r = top & MASK, top >> PLACE
            j = after[i]
            if rank(symbols[i] * base + symbols[j]) != r:
                continue  # one of the two has merged since
            symbols[i] = new = into[r]
            symbols[j] = GONE
            after[i] = j = after[j]
            if (r := rank(new * base + symbols[j])) is not None:
                push(queue, r << PLACE | i)
            if j < n:
                before[j] = i
            k = before[i]
            if k >= 0 and (r := rank(symbols[k] * base + new)) is not None:
                push(queue, r << PLACE | k)
        return [x for x in symbols if x >= 0]


class Encoder(Vocabulary):
    """Whole columns of text to ids: the pieces are cut as the vocabulary file says, the merges are those above."""

    def __init__(self, path: str, limit: int = 1 << 19):
        super().__init__(path, limit)
        self.merges, self.specials = Merges(path), {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # the ids of single bytes, inside a piece and at its end
        self.inner, self.last = ([self.merges.ids[sign + end] for sign in self.signs.values()] for end in ("", self.merges.end))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def clear(self) -> None:
        super().clear()
        self.known: dict[str, list[int]] = {}

    def ids_of(self, piece: bytes) -> list[int]:
        return self.merges.merged([*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]])

    def odd(self, text: str) -> list[int]:
        """Special tokens as they stand; what is between them is normalised and cut by the library."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                if piece not in self.known:
                    if len(self.known) > self.limit:
                        self.known.clear()
                    self.known[piece] = self.merges.merged(self.merges.symbols(piece))
                out += self.known[piece]
        return out


class Decoder:
    """Ids to text: vocabulary strings one after the other, as the file's decoder joins them.

    Without a decoder a space stands between two strings, which stay as they are; a byte-level one turns their signs into bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        strings = {i: s for s, i in whole["model"]["vocab"].items()}
        self.kind = (whole.get("decoder") or {}).get("type")
        if self.kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {self.kind}")
        signs = {s: b for b, s in byte_signs().items()}
        for i, s in strings.items() if self.kind else []:
            strings[i] = bytes(signs[x] for x in s)
        for t in whole["added_tokens"]:
            strings[t["id"]] = t["content"].encode() if self.kind else t["content"]
        self.strings = strings

    def decoded(self, ids: list[int]) -> str:
        found = map(self.strings.__getitem__, ids)
        return b"".join(found).decode("utf-8", "replace") if self.kind else " ".join(found)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def _with(batch: pa.RecordBatch, keep: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], [*keep, name])


def _schema(df: DataFrame, keep: list[str], name: str, kind) -> StructType:
    if name in keep:
        raise ValueError(f"{name} is a column already")
    return StructType([df.schema[c] for c in keep] + [StructField(name, kind)])


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "ids") -> DataFrame:
    """The columns ``keep`` and the token ids of each whole text, without special tokens added; those that a text holds are tokens.

    Rows stay as they come, with null ids and repeats. A null text is empty and has no ids; an empty table gives no rows.
    """
    keep, given = list(keep), text_col
    inner = "text" if "text" not in keep else "_text"
    schema = _schema(docs, keep, name, ArrayType(IntegerType(), False))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [x[:-1] for x in encoder_of(tokenizer).documents(batch.column(inner), 0)]
        at = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
        return _with(batch, keep, name, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got).astype(np.int32))))

    return docs.select(*keep, docs[given].cast(StringType()).alias(inner)).mapInArrow(per_batch(f, inner), schema)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), name: str = "decoded") -> DataFrame:
    """The columns ``keep`` and the text that the ids stand for, special tokens included; no ids, or null, are an empty text.

    An id that the vocabulary does not have raises an error.
    """
    keep = list(keep)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        decoder = decoder_of(tokenizer)
        return _with(batch, keep, name, pa.array([decoder.decoded(x.values.to_pylist() if x.is_valid else []) for x in batch.column(ids_col)], pa.string()))

    return encoded.mapInArrow(per_batch(f, lists=ids_col), _schema(encoded, keep, name, StringType()))
