"""Text to tables: format detection and the parsers of delimited text, JSON, JSON Lines and Markdown."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

FORMATS = ("auto", "html", "csv", "tsv", "json", "jsonl", "markdown")
# fixed values: candidate delimiters in order of preference, and what a number looks like to the header test
DELIMITERS = ("\t", ",", ";", "|")
NUMERIC = re.compile(r"^[-+(]?[$€£¥₹]?\s?[\d,.\s]+%?\)?$")
#: The line under a Markdown header.
_RULE = re.compile(r"^\s*\|?[\s:|-]+\|[\s:|-]*$")


@dataclass
class Table:
    headers: list[str]
    rows: list[list[str]] = field(default_factory=list)
    caption: str = ""
    has_merges: bool = False


def detect_format(text: str) -> str:
    body = text.strip()
    if not body:
        return "csv"
    if body[0] == "<" or re.search(r"</?table[\s>]", body, re.I):
        return "html"
    if body[0] in "[{":
        try:
            json.loads(body)
            return "json"
        except ValueError:
            pass
    lines = [x.strip() for x in body.splitlines() if x.strip()]
    if len(lines) > 1 and all(x.startswith("{") and x.endswith("}") for x in lines[:5]):
        return "jsonl"
    if len(lines) > 1 and "|" in lines[0] and _RULE.match(lines[1]):
        return "markdown"
    return "tsv" if sniff_delimiter(text) == "\t" else "csv"


def outside_quotes(line: str, sign: str) -> int:
    return sum(part.count(sign) for part in line.split('"')[::2])


def sniff_delimiter(text: str) -> str:
    """The sign with the highest mean count, times the share of lines that have it, less the variance of its counts."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    best, best_score = ",", -1.0
    for sign in DELIMITERS:
        counts = [outside_quotes(x, sign) for x in lines]
        with_any = sum(c > 0 for c in counts)
        if not with_any:
            continue
        mean = sum(counts) / len(counts)
        score = mean * with_any / len(counts) - sum((c - mean) ** 2 for c in counts) / len(counts)
        if score > best_score:
            best, best_score = sign, score
    return best


def split_delimited(text: str, delimiter: str) -> list[list[str]]:
    """Records of RFC 4180 text: quotes open at a field's start only, doubled ones are literal, blank records go."""
    field_of = re.compile(rf'(?:"((?:[^"]|"")*)"([^{re.escape(delimiter)}\n]*)|([^{re.escape(delimiter)}\n]*))({re.escape(delimiter)}|\n|\Z)')
    rows, row, at, text = [], [], 0, text.removeprefix("﻿").replace("\r\n", "\n")
    while at <= len(text):
        m = field_of.match(text, at)
        if m is None:  # a quote that never closes takes the rest
            row.append(text[at + 1 :].replace('""', '"'))
            rows.append(row)
            row, at = [], len(text) + 1
            break
        quoted = m.group(1)
        row.append((quoted.replace('""', '"') + m.group(2).replace("\r", "")) if quoted is not None else m.group(3).replace("\r", ""))
        at = m.end()
        if m.group(4) != delimiter:
            rows.append(row)
            row = []
            if m.group(4) == "":
                break
    return [r for r in rows if any(c.strip() for c in r)]


def padded(rows: list[list[str]]) -> list[list[str]]:
    width = max((len(r) for r in rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def is_header(row: list[str]) -> bool:
    first = [c.strip() for c in row]
    filled = [c for c in first if c]
    return not any(NUMERIC.match(c) for c in filled) and len(filled) >= max(1, int(0.6 * len(row))) and all(len(c) <= 80 for c in row)


def to_table(rows: list[list[str]], has_header: bool | None = None) -> Table:
    """Header inference: no number in the first row, most of it filled, no long cell."""
    from ..grid import unique_names

    rows = padded(rows)
    width = len(rows[0]) if rows else 0
    if has_header is None:
        has_header = len(rows) > 1 and is_header(rows[0])
    if has_header and rows:
        return Table(unique_names(rows[0]), rows[1:])
    return Table([f"Column {i + 1}" for i in range(width)], rows)


def json_cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def from_json(value, has_header: bool | None = None) -> Table:
    """A list of rows, of records (headers are the union of keys as first seen) or of scalars, by its first item; an object gives its first list, or one record."""
    from ..grid import unique_names

    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), [value])
    if not isinstance(value, list):
        raise ValueError("JSON without a list or an object holds no table")
    if value and isinstance(value[0], list):
        if not all(isinstance(r, list) for r in value):
            raise ValueError("a list of rows holds something else")
        return to_table([[json_cell(c) for c in r] for r in value], has_header)
    keys = list(dict.fromkeys(k for r in value if isinstance(r, dict) for k in r))
    if not keys:
        return to_table([[json_cell(r)] for r in value], has_header=False)
    return Table(unique_names(keys), [[json_cell(r.get(k)) if isinstance(r, dict) else "" for k in keys] for r in value])


def is_rule(line: str) -> bool:
    return "-" in line and bool(_RULE.match(line))


def markdown_cells(line: str) -> list[str]:
    bare = line.removeprefix("|").removesuffix("|")
    return [re.sub(r"<br\s*/?>", "\n", c.strip().replace(r"\|", "|"), flags=re.I) for c in re.split(r"(?<!\\)\|", bare)]


def parse_markdown(text: str) -> Table:
    """The lines with pipes; the row above the first rule is the header, those above that are rows. Without such a row the header is looked for."""
    from ..grid import unique_names

    lines = [x for x in map(str.strip, text.splitlines()) if "|" in x]
    if not lines:
        raise ValueError("no Markdown table in this text")
    rows, header = [], None
    for line in lines:
        if is_rule(line):
            if rows and header is None:
                header = rows.pop()
            continue
        rows.append(markdown_cells(line))
    if header is None:
        return to_table(rows)
    width = max(len(r) for r in [header, *rows])
    header, *rows = [r + [""] * (width - len(r)) for r in [header, *rows]]
    return Table(unique_names(header), rows)


def parse_text(text: str, fmt: str = "auto", has_header: bool | None = None, delimiter: str | None = None) -> tuple[Table, str]:
    fmt = detect_format(text) if fmt == "auto" else fmt
    if fmt in ("csv", "tsv"):
        return to_table(split_delimited(text, delimiter or ("\t" if fmt == "tsv" else sniff_delimiter(text))), has_header), fmt
    if fmt == "json":
        return from_json(json.loads(text), has_header), fmt
    if fmt == "jsonl":
        return from_json([json.loads(x) for x in text.splitlines() if x.strip()], has_header), fmt
    if fmt == "markdown":
        return parse_markdown(text), fmt
    if fmt == "html":
        from .html import largest_table

        return largest_table(text), fmt
    raise ValueError(f"unknown format {fmt}")
