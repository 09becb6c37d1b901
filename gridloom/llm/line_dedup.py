"""Line deduplication with a log-template tree of fixed depth.

A line's tokens are masked (a token with a digit is a variable field) and it is parsed into a leaf by its token count, its
leading and its closing tokens. Below a leaf it stands in branches: one for each block of its other tokens, and one for all of
them but that block. Blocks are so many that two lines that agree at enough positions share one at least. The masked line that
most documents have is a branch's seed; a line is a variant of the commonest of the seeds of its branches that it agrees
with at most positions, and a seed with variants is one of its own. So each line meets as many seeds as it has branches,
whatever else its leaf holds, and one pass finds all templates. A masked line recurs if two documents have it, a template if
``variants`` documents have one of its lines. The first occurrence of what recurs stays, in the document with the smallest id; all
others are dropped. Lines with too few constant tokens to be masked (numbers, scripts without spaces) recur by their exact
tokens. Counts are by aggregation over hashes, so no group of equal lines meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_batch
from .textnp import Texts, U, mix

#: Leading and closing tokens that lead to a leaf.
DEPTH = 3
_MASK = U(0x5851F42D4C957F2D)


def lines(texts: Texts, min_tokens: int, min_chars: int):
    """(document, line, masked line, 32 more bits of its hash, leaf, codes of its tokens, masked or not) of lines with enough constant tokens, and of others of
    min_chars characters or more, which are hashed as they are and have no leaf."""
    starts, ends = texts.words()
    h = texts.hashes(starts, ends)
    digits = np.r_[0, np.cumsum((texts.data >= 48) & (texts.data <= 57))]
    variable = digits[ends] > digits[starts]
    exact, h = h, np.where(variable, _MASK, h)
    newlines = np.r_[0, np.cumsum(texts.data == 10)]
    doc = np.repeat(np.arange(texts.n), np.diff(texts.counts(starts)))
    line = newlines[starts] - newlines[texts.offsets[doc]]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.int32), none, pa.array([], pa.binary()), none.astype(bool)
    n = np.diff(np.r_[first, len(h)])
    at = np.arange(len(h)) - np.repeat(first, n)
    place = at.astype(U) * U(0x9E3779B97F4A7C15)
    whole, verbatim, more, more_verbatim = (mix(np.add.reduceat(mix(x + place), first) + n.astype(U)) for x in (h, exact, mix(h), mix(exact)))
    constant = n - np.add.reduceat(variable.astype(np.int64), first)
    masked = (constant >= min_tokens) & (2 * constant >= n)
    chars = np.r_[0, np.cumsum((texts.data & 0xC0) != 0x80)]
    keep = masked | (chars[ends[first + n - 1]] - chars[starts[first]] >= min_chars)
    whole, more = np.where(masked, whole, mix(verbatim ^ _MASK)), np.where(masked, more, more_verbatim)
    first, n, whole, more, masked = first[keep], n[keep], whole[keep], more[keep], masked[keep]
    leaf = n.astype(U)
    for k in range(DEPTH):
        leaf = mix(leaf * U(31) + h[first + np.minimum(k, n - 1)])
        leaf = mix(leaf * U(37) + h[first + np.maximum(0, n - 1 - k)])
    size = np.where(masked, n, 0)
    ends_at = np.r_[0, np.cumsum(size)]
    codes = (h[np.repeat(first - ends_at[:-1], size) + np.arange(ends_at[-1])] >> U(48)).astype("<u2")
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * ends_at).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
    return doc[first], line[first], whole.view(np.int64), (more >> U(32)).astype(np.uint32).view(np.int32), leaf.view(np.int64), packed, masked


def parsed(min_tokens: int, min_chars: int):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, line, whole, more, leaf, codes, masked = lines(Texts(batch.column(1)), min_tokens, min_chars)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(line, pa.int32()), pa.array(whole), pa.array(more), pa.array(leaf, mask=~masked), codes], ["doc", "line", "whole", "more", "leaf", "codes"])

    return per_batch(f, "text")


def branches(codes: pa.Array, leaf: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the branches of each line, and the line of each: of blocks between the leading and closing tokens, and of all but one block.

    A line of n tokens may disagree at the most with d = n - ceil(share * n) tokens of another, so of d + 1 blocks one agrees. Where
    there are not that many tokens between, all lines of the leaf agree, and it is the only branch.
    """
    n = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    flat = np.frombuffer(b"".join(codes.to_pylist()), "<u2").astype(U)
    ends = np.cumsum(n)
    at = np.arange(len(flat)) - np.repeat(ends - n, n)
    sums = np.r_[U(0), np.cumsum(mix(flat * U(0x9E3779B97F4A7C15) + at.astype(U)))]
    blocks = n - np.ceil(share * n - 1e-9).astype(np.int64) + 1
    between = np.maximum(0, n - 2 * DEPTH)
    few = between < blocks
    blocks = np.where(few, 0, blocks)
    line = np.repeat(np.arange(len(n)), blocks)
    k = np.arange(len(line)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (ends - n)[line] + DEPTH
    low, high = begin + between[line] * k // blocks[line], begin + between[line] * (k + 1) // blocks[line]
    own, every = sums[high] - sums[low], sums[begin + between[line]] - sums[begin]
    place = leaf.view(U)[line] * U(31) + k.astype(U)
    keys = np.concatenate([mix(mix(own) + place), mix(mix(every - own) ^ mix(place)), leaf.view(U)[few]])
    return keys.view(np.int64), np.concatenate([line, line, np.flatnonzero(few)])


def branched(share: float):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, line = branches(batch.column(3), batch.column(0).to_numpy(), share)
        return pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(k).take(pa.array(line)) for k in (1, 2))], ["branch", "whole", "docs"])

    return per_batch(f, "codes")


def agreeing(share: float):
    """The rows whose two lines have the same code at ``share`` of their places or more."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2") for k in ("codes", "seed_codes"))
        n = pc.binary_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        if not len(n):
            return batch.select(["whole", "seed", "seed_docs"])
        same = np.add.reduceat((a == b).astype(np.int64), np.cumsum(n) - n)
        return batch.select(["whole", "seed", "seed_docs"]).filter(pa.array(same >= share * n - 1e-9))

    return per_batch(f, "codes")


def templates(samples: DataFrame, scratch: Scratch, share: float) -> DataFrame:
    """(whole, template) of the masked lines (leaf, whole, docs, codes) that are variants of a seed, and of seeds with variants; a template is named by its seed."""
    keyed = scratch.keep(samples.select("leaf", "whole", "docs", "codes").mapInArrow(branched(share), "branch long, whole long, docs long"))
    # written, so that a branch with many lines can be split where it meets them
    tops = keyed.groupBy("branch").agg(F.max(F.struct("docs", "whole")).alias("top"), F.count("*").alias("n")).where("n > 1")
    tops = scratch.keep(tops.select(F.col("branch").alias("b"), F.col("top.whole").alias("seed"), F.col("top.docs").alias("seed_docs")))
    pairs = keyed.join(tops, F.col("branch") == F.col("b")).where("whole <> seed").select("whole", "seed", "seed_docs").distinct()
    codes = samples.select(F.col("whole").alias("w"), F.col("codes"))
    met = pairs.join(codes, F.col("whole") == F.col("w")).drop("w")
    met = scratch.keep(met).join(codes.select(F.col("w"), F.col("codes").alias("seed_codes")), F.col("seed") == F.col("w"))
    close = met.select("whole", "seed", "seed_docs", "codes", "seed_codes").mapInArrow(agreeing(share), "whole long, seed long, seed_docs long")
    member = scratch.keep(close.groupBy("whole").agg(F.max(F.struct("seed_docs", "seed"))["seed"].alias("template")))
    return member.unionAll(member.select(F.col("template").alias("whole"), "template").distinct())


def recurring(docs: DataFrame, scratch: Scratch, min_tokens: int = 3, min_chars: int = 10, copies: int = 2, variants: int = 5, share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line) of every line to drop, line counted from 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    found = scratch.keep(rows.mapInArrow(parsed(min_tokens, min_chars), "doc long, line int, whole long, more int, leaf long, codes binary"))

    # masked lines with the number of documents that have them
    each = scratch.keep(found.where("leaf is not null").select("leaf", "whole", "doc").distinct().groupBy("leaf", "whole").agg(F.count("*").alias("docs")))
    # written, so that a leaf with many lines can be split where it meets them
    mixed = scratch.keep(each.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where((F.col("kinds") > 1) & (F.col("docs") >= variants)).select("leaf"))
    samples = found.join(mixed, "leaf", "left_semi").groupBy("leaf", "whole").agg(F.min("codes").alias("codes"))
    samples = scratch.keep(samples.join(each, ["leaf", "whole"]).select("leaf", "whole", "docs", "codes"))
    # a line outside any template stands for itself
    member = scratch.keep(templates(samples, scratch, share).withColumnRenamed("whole", "w"))

    def beyond_first(part: DataFrame, key: list[str], least: int) -> DataFrame:
        """The occurrences after the first of what has ``key``; the keys are written first, so that a frequent one can be split when it meets its rows."""
        many = part.groupBy(*key, "doc").agg(F.min("line").alias("line")).groupBy(*key).agg(F.count("*").alias("docs"), F.min(F.struct("doc", "line")).alias("first")).where(F.col("docs") >= least)
        many = scratch.keep(many.select(*key, "first"))
        return part.join(many, key).where(F.struct("doc", "line") != F.col("first")).select("doc", "line")

    named = found.where("leaf is not null").join(member, F.col("whole") == F.col("w")).select("template", "doc", "line")
    named = scratch.keep(named)
    same = beyond_first(found.select("whole", "more", "doc", "line"), ["whole", "more"], copies)
    out = scratch.keep(same.unionAll(beyond_first(named, ["template"], variants)).distinct())
    scratch.drop_all_but(out)
    return out


def without_recurring(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` with the recurring lines dropped from the text, and two more columns: n_lines and n_dropped, which replace columns of these names.

    Every row and column comes back; a text that loses all lines becomes empty. Lines are what newlines separate. Lines of fewer
    than ``min_tokens`` constant tokens, or of more variable than constant ones, recur only token by token as they are, and only
    if they have ``min_chars`` characters; repetition inside one document alone does not count. Null texts and rows with a null id stay as they are (n_lines 0 for null texts). Very long lines and texts are
    taken whole. Of ties the smallest line of the smallest id stays. Rows that repeat an id
    count as one document.
    """
    gone = recurring(docs, scratch, id_col=id_col, text_col=text_col, **rules)
    by_doc = gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("_gone")).withColumnRenamed("doc", "_of")
    joined = docs.drop("n_lines", "n_dropped").join(by_doc, F.col(id_col) == F.col("_of"), "left").drop("_of")
    n_lines = F.coalesce(F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1, F.lit(0)).cast("long")
    joined = joined.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")})
    out = joined.mapInArrow(without_lines(text_col), joined.schema)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*names, "n_lines", "n_dropped")


def without_lines(text_col: str):
    """Takes the numbered lines out of each text."""

    def cut(text: str, gone: list[int]) -> str:
        lines = np.array(text.split("\n"), object)
        return "\n".join(np.delete(lines, gone))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone, texts = batch.column("_gone"), batch.column(text_col)
        if gone.null_count == len(gone):
            return batch
        kept = [t.as_py() if not g.is_valid else cut(t.as_py(), g.values.to_numpy()) for t, g in zip(texts, gone, strict=True)]
        return batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(kept, texts.type))

    return per_batch(f, text_col)
