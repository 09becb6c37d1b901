"""Workbooks: the rows of the sheets are written and packed by the executors, the file is put together out of their parts.

A sheet is packed in pieces that need nothing of one another, so parts copied one behind the other are one packed stream. The
driver knows of each part its place, its lengths and its checksum; the checksum of a sheet follows from those of its parts. A
mark of white space ends each piece, so a workbook is read again by as many tasks as it has ranges.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .grid import Grid, numbered, numbered_in_ranges, released
from .shared import new_path

NUMERIC = ("number", "currency", "percent")
WIDEST = 60
#: Rows of a sheet, its header included; rows of a piece of it; bytes and entries from which the archive needs the wide form (zip64).
MOST_ROWS, PART_ROWS, MOST_BYTES, MOST_ENTRIES = 1_048_576, 100_000, (1 << 32) - 1, (1 << 16) - 1
#: Bytes of a piece before it is packed (one row may have more), pieces of a part, and how hard they are packed.
PIECE_BYTES, PART_PIECES, LEVEL = 1 << 20, 64, 4
# fixed values: white space behind each piece, whose first sign it has once, and what a packed stream has before so many bytes as they are
MARK = "\n \t\t  \t   \t\t \t \t"
_BEFORE_MARK = struct.pack("<BHH", 0, len(MARK), len(MARK) ^ 0xFFFF)
# fixed value: what the narrow form says where the wide one holds the number
_WIDE = (1 << 32) - 1

# fixed value: numbers that are written as they stand, because a double gives these few digits again
_AS_IT_IS = r"^(?:0|-?[1-9][0-9]{0,9}|-?(?:0|[1-9][0-9]{0,9})\.[0-9]{0,4}[1-9])\z"

# fixed values: the parts of a workbook besides its sheets, in the form that spreadsheet programs expect
_DECLARED = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE, _KIND = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
_STYLES = f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'


def column_letter(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def cell_xml(text: str) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", escape(text, {'"': "&quot;"}))


def sheet_names(title: str, n: int) -> list[str]:
    bare = re.sub(r"[\[\]:*?/\\]", "", title)[:31] or "Sheet1"
    return [bare] + [f"{bare[: 30 - len(str(i))]} {i}" for i in range(2, n + 1)]


def other_parts(title: str, n: int) -> dict[str, str]:
    """All parts but the ``n`` sheets."""
    sheets = range(1, n + 1)
    listed = "".join(f'<sheet name="{cell_xml(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(sheets, sheet_names(title, n), strict=True))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in sheets)
    links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in sheets)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{types}<Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{n + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _STYLES,
    }
    return {name: _DECLARED + text for name, text in parts.items()}


def sheet_ends(grid: Grid, widths: list[int]) -> tuple[str, str]:
    """What a sheet has before and behind its rows: the frozen header is before them."""
    columns = "".join(f'<col min="{i}" max="{i}" width="{min(WIDEST, max(8, w + 2))}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    header = "".join(f'<c r="{column_letter(i)}1" t="inlineStr" s="1"><is><t xml:space="preserve">{cell_xml(h)}</t></is></c>' for i, h in enumerate(grid.headers))
    head = f'{_DECLARED}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData><row r="1">{header}</row>'
    return head, "</sheetData></worksheet>"


def longest_cells(grid: Grid) -> dict[str, int]:
    return grid.df.agg(*[F.max(F.length(c)).alias(c) for c in grid.columns]).first().asDict() if grid.columns else {}  # one row


def column_widths(grid: Grid, longest: dict[str, int]) -> list[int]:
    return [max(len(h), longest.get(c) or 0) for h, c in zip(grid.headers, grid.columns, strict=True)]


def sheet_rows(grid: Grid, types: tuple[str, ...], numbers: DataFrame, most: int) -> DataFrame:
    """(sheet, r, line): each numbered row as the XML of its sheet, row 1 being the header."""
    sheet, r = (F.col("_n") / (most - 1)).cast("int") + 1, (F.col("_n") % (most - 1) + 2).cast("int")
    bare = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")

    def escaped(c):
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return c

    def cell(i: int, c: str, kind: str):
        at = F.concat(F.lit(f'<c r="{column_letter(i)}'), F.col("r").cast("string"))
        text = F.when(F.col(c) != "", F.concat(at, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), escaped(bare(F.col(c))), F.lit("</t></is></c>"))).otherwise("")
        if kind not in NUMERIC:
            return text
        number = lambda n: F.concat(at, F.lit('" t="n"><v>'), n, F.lit("</v></c>"))
        other = S.let(S.number_text(S.parse_number(F.col(c))), lambda n: F.when(n.isNotNull(), number(n)).otherwise(text))
        return F.when(F.col(c).rlike(_AS_IT_IS), number(F.col(c))).otherwise(other)

    cells = [cell(i, c, t) for i, (c, t) in enumerate(zip(grid.columns, types, strict=True))]
    return numbers.withColumns({"sheet": sheet, "r": r}).select("sheet", "r", F.concat(F.lit('<row r="'), F.col("r").cast("string"), F.lit('">'), *cells, F.lit("</row>")).alias("line"))


def xlsx(grid: Grid, types: tuple[str, ...] | None = None, title: str = "Sheet1") -> bytes:
    """A workbook of one sheet as bytes, for results that fit on the driver; ``write_workbook`` takes any number of rows."""
    numbers, total = numbered(grid.df)
    if total >= MOST_ROWS:
        raise ValueError("a sheet has no more than 1,048,576 rows")
    head, foot = sheet_ends(grid, column_widths(grid, longest_cells(grid)))
    rows = sheet_rows(grid, types or ("text",) * len(grid.columns), numbers, MOST_ROWS).orderBy("r").select("line").toLocalIterator()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in other_parts(title, 1).items():
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet1.xml", head + "".join(r["line"] for r in rows) + foot)
    released(numbers)
    return out.getvalue()


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32; the highest bit is the power 0."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts one behind the other, out of both checksums and the length of the second: the first is moved on by so many bytes."""
    moved, step = 1 << 31, 1 << 23  # 1, and one byte
    while length:
        if length & 1:
            moved = _times(step, moved)
        step, length = _times(step, step), length >> 1
    return _times(moved, first) ^ second


def wide(numbers: bytes) -> bytes:
    """The extra field of an entry that holds its numbers in the wide form."""
    return struct.pack("<HH", 1, len(numbers)) + numbers if numbers else b""


def packed(text: bytes, last: bool = False) -> bytes:
    """A piece of a packed stream that refers to nothing before it and lacks only its mark; the last one ends the stream and has none."""
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, strategy)
        piece = c.compress(text) + (c.flush(zlib.Z_FINISH) if last else c.flush(zlib.Z_FULL_FLUSH) + _BEFORE_MARK)
        if MARK.encode() not in piece:
            return piece
    raise ValueError("a packed piece holds the mark between pieces")


def unpacked(piece: bytes) -> bytes:
    return zlib.decompressobj(-zlib.MAX_WBITS).decompress(piece)


def packed_rows(lines: DataFrame, most: int) -> DataFrame:
    """(sheet, r, piece): neighbouring rows of a sheet, ``most`` at most, packed; r is the first one's."""

    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            sheet, r, line = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            ends = np.cumsum([len(x) for x in line])
            news = (np.diff(sheet) != 0) | (np.diff(r) != 1) | (np.diff(ends // PIECE_BYTES) != 0) | (np.arange(1, len(line)) % most == 0)
            cuts = [0, *(np.flatnonzero(news) + 1).tolist(), len(line)]
            pieces = [packed(b"".join(line[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(sheet[cuts[:-1]], pa.int32()), pa.array(r[cuts[:-1]], pa.int32()), pa.array(pieces, pa.binary())], ["sheet", "r", "piece"])

    return lines.select("sheet", "r", F.col("line").cast("binary")).mapInArrow(run, "sheet int, r int, piece binary")


def told_of_parts(spark: SparkSession, folder: str) -> list:
    """Of each part its sheet, path and length, the number of its first row and of its rows, and the size and checksum of what it unpacks to, by sheet and row."""

    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            told = []
            for content in batch.column(3):
                first, n, size, crc = 0, 0, 0, 0
                for piece in content.as_py().split(MARK.encode())[:-1]:
                    text = unpacked(piece) + MARK.encode()
                    first = first or int(text[len('<row r="') : text.index(b'">')])
                    n, size, crc = n + text.count(b"<row "), size + len(text), zlib.crc32(text, crc)
                told.append((first, n, size, crc))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in zip(*told, strict=True))], [*batch.schema.names[:3], "r", "n", "size", "crc"])

    parts = spark.read.format("binaryFile").load(folder).select(F.col("sheet").cast("int").alias("sheet"), "path", "length", "content")
    return sorted(parts.mapInArrow(run, "sheet int, path string, length long, r long, n long, size long, crc long").collect(), key=lambda p: (p.sheet, p.r))  # one row a part


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(value): the rows of all sheets of a workbook that ``write_workbook`` has written, as XML without their ends and without headers; in any order."""

    def run(batches):
        for batch in batches:
            for piece in batch.column(0):
                # what is before the first mark has the begin of the archive, what is behind the last one of a sheet its end and the next one's begin
                if not (piece := piece.as_py()).startswith(b"PK") and len(rows := unpacked(piece).split(b"</row>")) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:-1], pa.binary())], ["value"])

    return spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary")).mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def write_parts(grid: Grid, numbers: DataFrame, types: tuple[str, ...], most_rows: int, total: int, folder: str) -> list | None:
    """Writes the rows of the sheets, packed, and tells of the parts; None if the rows were not those that had been counted."""
    lines = sheet_rows(grid, types, numbers, most_rows)
    # the numbers grow within partitions, so pieces are few; their own order is by number, whatever partition they come from
    pieces = packed_rows(lines, PART_ROWS).sortWithinPartitions("sheet", "r").select("sheet", F.col("piece").cast("string"))
    pieces.write.partitionBy("sheet").option("lineSep", MARK).option("maxRecordsPerFile", PART_PIECES).text(folder)
    parts, at = told_of_parts(grid.df.sparkSession, folder), 0
    for p in parts:
        if (p.sheet - 1) * (most_rows - 1) + p.r - 2 != at:
            return None
        at += p.n
    return parts if at == total else None


def write_workbook(grid: Grid, path: str, types: tuple[str, ...] | None = None, title: str = "Sheet1", most_rows: int = MOST_ROWS) -> None:
    """One workbook of any number of rows: what does not fit on a sheet goes on on the next. From 4 GB on the archive has the wide form (zip64).

    Parts go as they are copied, so scratch and workbook together take little more than the workbook.
    """
    spark = grid.df.sparkSession
    jvm, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    types, scratch = types or ("text",) * len(grid.columns), new_path(spark, "workbook")
    found = None
    if grid.steady:
        numbers, total, longest = numbered_in_ranges(grid.df)
        found = write_parts(grid, numbers, types, most_rows, total, f"{scratch}/a") if total else []
    if found is None:
        numbers, total = numbered(grid.df, in_order=grid.in_order)
        longest = longest_cells(grid.with_df(numbers.drop("_n")))
        found = write_parts(grid, numbers, types, most_rows, total, f"{scratch}/b") if total else []
        released(numbers)
        if found is None:
            raise ValueError("the rows changed while they were written")
    n_sheets = max(1, -(-total // (most_rows - 1)))
    parts: dict[int, list] = {i: [] for i in range(1, n_sheets + 1)}
    for p in found:
        parts[p.sheet].append((p.path, p.length, p.size, p.crc))
    begin, end = (x.encode() for x in sheet_ends(grid, column_widths(grid, longest)))
    head, foot = (packed(begin) + MARK.encode(), begin + MARK.encode()), (packed(end, last=True), end)
    entries = [(name, [(packed(text.encode(), last=True), text.encode())]) for name, text in other_parts(title, n_sheets).items()]
    entries += [(f"xl/worksheets/sheet{i}.xml", [head, *parts[i], foot]) for i in parts]

    target = jvm.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    at, directory, any_large = 0, b"", False
    for name, pieces in entries:
        crc = size = short = 0
        for piece in pieces:
            length, own_size, own = piece[1:] if isinstance(piece[0], str) else (len(piece[0]), len(piece[1]), zlib.crc32(piece[1]))
            crc, size, short = joined_crc(crc, own, own_size), size + own_size, short + length
        large, far = max(size, short) >= MOST_BYTES, at >= MOST_BYTES
        any_large |= large
        shown, version = (_WIDE, _WIDE) if large else (short, size), 45 if large or far else 20
        label, about = name.encode(), struct.pack("<HHHHHIII", version, 0x0800, 8, 0, 33, crc, *shown)  # packed, on 1 January 1980
        sizes = struct.pack("<QQ", size, short) if large else b""
        own = wide(sizes)
        header = struct.pack("<I", 0x04034B50) + about + struct.pack("<HH", len(label), len(own)) + label + own
        own = wide(sizes + (struct.pack("<Q", at) if far else b""))
        directory += struct.pack("<IH", 0x02014B50, version) + about + struct.pack("<HHHHHII", len(label), len(own), 0, 0, 0, 0, _WIDE if far else at) + label + own
        out.write(header)
        for piece in pieces:
            if isinstance(piece[0], bytes):
                out.write(piece[0])
            else:
                part = jvm.fs.Path(piece[0])
                fs = part.getFileSystem(conf)
                data = fs.open(part)
                jvm.io.IOUtils.copyBytes(data, out, 1 << 16, False)
                data.close()
                fs.delete(part, False)
        at += len(header) + short
    n, end = len(entries), b""
    if any_large or n >= MOST_ENTRIES or at + len(directory) >= MOST_BYTES:
        end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    narrow = (min(n, 0xFFFF),) * 2 + ((_WIDE, _WIDE) if end else (len(directory), at))
    out.write(directory + end + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *narrow, 0))
    out.close()
    made = jvm.fs.Path(scratch)
    made.getFileSystem(conf).delete(made, True)
