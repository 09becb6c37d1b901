"""Records of files that are split among tasks, where the end of a record cannot be told from its own range.

A newline in a quoted field ends no record, and a brace ends an element of a JSON list only at the right depth, so what a range
holds depends on what comes before it. A first pass reads each range from every state it may begin in and says in which state
it leaves each; composed in order these tell the state of each range - one small row for each range of a file that has several.
A second pass then gives the records. Those that reach over ranges come in pieces and are put together.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is in a range's record: all of it, its begin, its end, or neither.
WHOLE, BEGIN, MIDDLE, END = "whole", "begin", "middle", "end"
_INSIDE_QUOTES = re.compile(r'[^"]*(?:""[^"]*)*')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*', re.S)


@dataclass(frozen=True)
class Delimited:
    """Units are lines; a record ends with a line unless a quote that opened at a field's start is open."""

    delimiter: str
    unit = "\n"

    def left(self, line: str, quoted: bool) -> tuple[bool, int, int]:
        """Whether a quote is open after a line; depth does not matter here."""
        if '"' not in line:
            return quoted, 0, 0
        at = 0
        while True:
            if not quoted:
                while line[at : at + 1] == "\r":
                    at += 1
                quoted = line[at : at + 1] == '"'
                at += quoted
            if quoted:
                at = _INSIDE_QUOTES.match(line, at).end()
                if at >= len(line):
                    return True, 0, 0
                quoted = False
            at = line.find(self.delimiter, at)
            if at < 0:
                return False, 0, 0
            at += len(self.delimiter)

    def opened(self, text: str) -> int | None:
        return 1 if text.startswith("﻿") else 0

    def record(self, units: list[str]) -> list[str]:
        return ["\n".join(units)]

    def joined(self, units: list[str]) -> str:
        return "\n".join(units)


def fields(record: str, delimiter: str) -> list[str]:
    """The fields of a record: quotes open at a field's start only, doubled ones are literal, text behind a closing one stays; one that never closes takes the rest."""
    if '"' not in record:
        return record.replace("\r", "").split(delimiter)
    out, at = [], 0
    while True:
        while record[at : at + 1] == "\r":
            at += 1
        value = ""
        if record[at : at + 1] == '"':
            end = _INSIDE_QUOTES.match(record, at + 1).end()
            value, at = record[at + 1 : end].replace('""', '"'), end + 1
        stop = record.find(delimiter, at)
        out.append(value + record[at : stop if stop >= 0 else len(record)].replace("\r", ""))
        if stop < 0:
            return out
        at = stop + len(delimiter)


@dataclass(frozen=True)
class JsonList:
    """Units end with the bracket that closes the elements of a list; a record ends with one at the list's own depth."""

    unit: str = "}"

    def left(self, text: str, quoted: bool) -> tuple[bool, int, int]:
        """Whether a string is open after a unit, by how much it changes the depth, and how far down it goes on the way."""
        at = 0
        if quoted:
            at = _STRING_END.match(text).end()
            if at >= len(text):
                return True, 0, 0
            at += 1
        bare = _STRING.sub("", text[at:])
        cut = bare.find('"')
        quoted, bare = cut >= 0, bare if cut < 0 else bare[:cut]
        depth = low = 0
        for sign in re.findall(r"[][{}]", bare + self.unit * (not quoted)):
            depth += 1 if sign in "[{" else -1
            low = min(low, depth)
        return quoted, depth, low

    def opened(self, text: str) -> int | None:
        """Where the list begins: behind the first bracket, or the first that is a value of the object the text begins with."""
        if m := re.match(r"﻿?\s*\[", text):
            return m.end()
        depth = 0
        for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[][{}]', text):
            if m[0] == "[" and depth == 1:
                return m.end()
            depth += (m[0] in "[{") - (m[0] in "]}")
        return None

    def record(self, units: list[str]) -> list[str]:
        """The elements in a record: the one that its end closes, after those that are no objects."""
        text = "".join(u + self.unit for u in units).lstrip(", \t\r\n")
        if text[:1] == {"}": "{", "]": "["}[self.unit]:
            return [text]
        return elements(text)

    def joined(self, units: list[str]) -> str:
        return "".join(u + self.unit for u in units)


def elements(text: str) -> list[str]:
    """The texts of JSON values that commas part, up to the end of their list."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while True:
        at = re.compile(r"[\s,]*").match(text, at).end()
        if at >= len(text) or text[at] == "]":
            return out
        end = decoder.raw_decode(text, at)[1]
        out.append(text[at:end])
        at = end


def units_of(spark: SparkSession, path: str, unit: str) -> DataFrame:
    return spark.read.option("lineSep", unit).text(path).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), "value")


_LEFT = pa.list_(pa.struct([("quoted", pa.bool_()), ("depth", pa.int32()), ("low", pa.int32())]))


def by_range(batches) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        paths, blocks, values = (batch.column(k).to_pylist() for k in range(3))
        yield from zip(zip(paths, blocks, strict=True), values, strict=True)


def left_by_ranges(scan):
    """For each range and each way to begin it: whether it leaves a quote open, and how the depth changes."""

    def run(batches):
        key, states, head = None, [], ""

        def told():
            ways = [{"quoted": q, "depth": d, "low": low} for q, d, low in states]
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([ways], _LEFT)], ["file_path", "block", "left"])

        for found, unit in by_range(batches):
            if found != key:
                if key:
                    yield told()
                key, states, head = found, [(False, 0, 0), (True, 0, 0)], "" if found[1] == 0 else None
            if head is not None:  # the begin of a file, before its list
                head += unit
                at = scan.opened(head)
                if at is None:
                    head += scan.unit
                    continue
                unit, head = head[at:], None
            after = {q: scan.left(unit, q) for q in {s[0] for s in states}}
            states = [(after[q][0], d + after[q][1], min(low, d + after[q][2])) for q, d, low in states]
        if key:
            yield told()

    return run


def records_of_ranges(scan, begins: dict[tuple[str, int], tuple[bool, int, bool] | None]):
    """The records of each range: n, kind, texts. A range of a file that is one range begins as a file does."""

    def run(batches):
        key, rows = None, []

        def flushed(last: bool):
            nonlocal rows
            if rows and (last or len(rows) >= 4096):
                columns = list(zip(*rows, strict=True))
                rows = []
                return [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], ["file_path", "block", "n", "kind", "texts"])]
            return []

        def ended():
            if key and held and not done:
                text = scan.joined(held)
                rows.append((*key, n, END_OF_RANGE[cut], [text]))

        for found, unit in by_range(batches):
            if found != key:
                ended()
                yield from flushed(False)
                if found[1] and found not in begins:
                    raise ValueError("the files were split in another way than before: read again")
                key, held, n = found, [], 0
                quoted, depth, done = begins.get(found) or (False, 0, False)
                cut = quoted or depth > 0  # what comes first ends a record that an earlier range began
                head = "" if found[1] == 0 else None
            if done:
                continue
            if head is not None:
                head += unit
                at = scan.opened(head)
                if at is None:
                    head += scan.unit
                    continue
                unit, head = head[at:], None
            quoted, change, low = scan.left(unit, quoted)
            done = depth + low < 0
            depth += change
            held.append(unit)
            if done:
                rows.append((*key, n, END if cut else WHOLE, [scan.joined(held)] if cut else elements(scan.joined(held))))
            elif not quoted and depth == 0:
                rows.append((*key, n, END, [scan.joined(held)]) if cut else (*key, n, WHOLE, scan.record(held)))
                held, n, cut = [], n + 1, False
                yield from flushed(False)
        ended()
        yield from flushed(True)

    #: The rest of a range, by whether a record has ended in it or it began as one.
    END_OF_RANGE = {True: MIDDLE, False: BEGIN}
    return run


def records(spark: SparkSession, path: str, scan) -> DataFrame:
    """(file_path, block, n, text): the records of files in the order of block and n. A record has to fit in a worker."""
    units = units_of(spark, path, scan.unit)
    left = units.mapInArrow(left_by_ranges(scan), "file_path string, block long, left array<struct<quoted: boolean, depth: int, low: int>>")
    several = F.count("*").over(Window.partitionBy("file_path")) > 1
    by_file = defaultdict(list)
    for r in left.withColumn("several", several).where("several").collect():  # one row for each range of files that have several
        by_file[r.file_path].append(r)
    begins = {}
    for name, found in by_file.items():
        quoted, depth, done = False, 0, False
        for r in sorted(found, key=lambda r: r.block):
            begins[name, r.block] = quoted, depth, done
            way = r.left[quoted]
            done = done or depth + way.low < 0
            quoted, depth = way.quoted, depth + way.depth
    found = units.mapInArrow(records_of_ranges(scan, begins), "file_path string, block long, n long, kind string, texts array<string>")
    whole = found.where(F.col("kind") == WHOLE).select("file_path", "block", "n", F.posexplode("texts").alias("k", "text"))
    if not begins:
        return whole
    # at most two pieces for each range
    pieces = found.where(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == BEGIN).cast("int")).over(Window.partitionBy("file_path").orderBy("block", "n")))
    glue = "\n" if isinstance(scan, Delimited) else ""
    parts = F.array_sort(F.collect_list(F.struct("block", "n", F.get("texts", F.lit(0)).alias("text"))))
    put = pieces.groupBy("file_path", "record").agg(parts.alias("parts")).select("file_path", F.get("parts", F.lit(0))["block"].alias("block"), F.get("parts", F.lit(0))["n"].alias("n"), F.array_join(F.transform("parts", lambda p: p["text"]), glue).alias("text"))
    return whole.unionByName(put.mapInArrow(parted(scan), "file_path string, block long, n long, k int, text string"))


def parted(scan):
    """The elements of records that were put together."""

    def run(batches):
        for batch in batches:
            rows = [(p, b, n, k, t) for p, b, n, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for k, t in enumerate([text] if isinstance(scan, Delimited) else elements(text))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file_path", "block", "n", "k", "text"])

    return run


def split_records(found: DataFrame, delimiter: str) -> DataFrame:
    """(file_path, block, n, cells) of the records that are not blank."""

    def run(batches):
        for batch in batches:
            cells = [fields(t, delimiter) for t in batch.column(3).to_pylist()]
            keep = [i for i, c in enumerate(cells) if any(x.strip() for x in c)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(keep, pa.int64())) for k in range(3)), pa.array([cells[i] for i in keep], pa.list_(pa.string()))], ["file_path", "block", "n", "cells"])

    return found.select("file_path", "block", "n", "text").mapInArrow(run, "file_path string, block long, n long, cells array<string>")


def sizes_of(spark: SparkSession, path: str) -> int:
    """The bytes of the largest file; nothing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # one row
