"""Applies a GridSpec, one lazy step after the other, in the order that the specification fixes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..grid import POS, Grid, carried_last, numbered, unique_names
from ..operators.combine import transposed
from ..operators.profile import infer_types
from .spec import GridSpec, header_case, unsafe_pattern

#: Rows to skip that one task may find; more are counted by buckets.
SKIPPED = 10_000


def sort_key(cell, kind: str):
    """What a column of a type is sorted by; blank and unparseable cells are null."""
    if kind in ("number", "currency", "percent"):
        return S.parse_number(cell)
    return F.when(~S.blank(cell), S.date_key(cell) if kind == "date" else S.natural_key(cell))


def replaced(cell, find: str, replacement: str, regex: bool, case_sensitive: bool):
    """Replacement in every cell; $1 and $& in the replacement stand for what was found."""
    pattern = find if regex else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", find)
    java = re.sub(r"\$&", r"$0", replacement.replace("\\", "\\\\"))
    java = re.sub(r"\$(?![\d])", r"\\$", java.replace("$$", "\0")).replace("\0", r"\$")
    return F.regexp_replace(cell, F.lit(pattern if case_sensitive else f"(?i){pattern}"), F.lit(java))


def apply_spec(grid: Grid, spec: GridSpec) -> Grid:
    df, columns, error = grid.df, grid.columns, None
    origin = dict(zip(columns, range(len(columns)), strict=True))
    if spec.skip_rows:
        if spec.skip_rows <= SKIPPED:
            last = df.select(POS).orderBy(POS).limit(spec.skip_rows).agg(F.max(POS)).first()[0]  # one row
            df = df if last is None else df.where(F.col(POS) > last)
        else:
            df = numbered(df)[0].where(F.col("_n") >= spec.skip_rows).drop("_n")
    needs_types = spec.clean_values
    types = infer_types(grid.with_df(df)) if needs_types else ("text",) * len(columns)
    headers = [spec.renames.get(i) or h for i, h in enumerate(grid.headers)]
    if spec.clean_values:
        df = df.select(POS, *[S.clean_value(F.col(c), t, spec.normalise_dates, spec.percent_as_fraction).alias(c) for c, t in zip(columns, types, strict=True)])
    if spec.fill_down:
        filled = [c for c in columns if origin[c] in spec.fill_down]
        carried = carried_last(df, {f"_f_{c}": F.when(~S.blank(F.col(c)), F.col(c)) for c in filled})
        df = carried.select(POS, *[F.coalesce(f"_f_{c}", c).alias(c) if c in filled else F.col(c) for c in columns])
    if spec.trim_cells:
        df = df.select(POS, *[S.trimmed(F.col(c)).alias(c) for c in columns])
    if spec.replace and spec.replace.find:
        error = unsafe_pattern(spec.replace.find, df.sparkSession) if spec.replace.regex else None
        if not error:
            r = spec.replace
            df = df.select(POS, *[replaced(F.col(c), r.find, r.replacement, r.regex, r.case_sensitive).alias(c) for c in columns])
    gone = {c for c in columns if origin[c] in spec.hidden}
    if spec.drop_empty:
        df = df.where(~F.forall(F.array(*columns), lambda x: S.trimmed(x) == ""))
        nameless = [c for c, h in zip(columns, headers, strict=True) if not h.strip() or re.fullmatch(r"Column \d+", h)]
        if nameless:
            full = df.agg(*[F.max(~S.blank(F.col(c))).alias(c) for c in nameless]).first()
            gone |= {c for c in nameless if not full[c]}
    kept = [c for c in columns if c not in gone]
    listed = [columns[i] for i in spec.order if 0 <= i < len(columns) and columns[i] in kept]
    kept = list(dict.fromkeys(listed)) + [c for c in kept if c not in listed]
    names = dict(zip(columns, headers, strict=True))
    headers = [names[c] for c in kept]
    if spec.header_case != "none":
        headers = unique_names([header_case(h, spec.header_case) for h in headers])
    df = df.select(POS, *kept)
    if spec.search:
        needle = F.lower(F.lit(spec.search))
        df = df.where(F.exists(F.array(*kept), lambda x: F.contains(F.lower(x), needle)) if kept else F.lit(False))
    if spec.dedupe and kept:
        # the earliest of equal rows, by partial aggregation: equal rows never meet in one task
        df = df.groupBy(*kept).agg(F.min(POS).alias(POS)).select(POS, *kept)
    ordered = [F.col(POS).asc()]
    if spec.sort and 0 <= spec.sort.column < len(columns) and columns[spec.sort.column] in kept:
        c = columns[spec.sort.column]
        kind = infer_types(Grid(df.select(POS, c), ("",)))[0]
        # a column of its own: an expression would be worked out again at every comparison
        df, key = df.withColumn("_key", sort_key(F.col(c), kind)), F.col("_key")
        # blank cells come last either way, ties keep their order
        ordered = [key.desc_nulls_last() if spec.sort.direction == "desc" else key.asc_nulls_last(), *ordered]
    if spec.limit:
        df = df.orderBy(*ordered).limit(spec.limit)
    if len(ordered) > 1:
        df = df.orderBy(*ordered).withColumn(POS, F.monotonically_increasing_id())
    out = Grid(df.select(POS, *kept), tuple(headers), tuple(origin[c] for c in kept), grid.caption, None, error, in_order=len(ordered) > 1)
    return transposed(out) if spec.transpose else out


def ranked(grid: Grid, name: str = "rank"):
    """Adds the rank of each row, from 1, at any size."""
    df, _ = numbered(grid.df, name, grid.in_order)
    return df.withColumn(name, F.col(name) + 1)
