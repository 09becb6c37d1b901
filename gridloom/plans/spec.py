"""The declarative clean-up specification."""

from __future__ import annotations

import json
import re
import subprocess
import sys
import time
from dataclasses import asdict, dataclass, field
from dataclasses import replace as changed

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException, IllegalArgumentException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Sort:
    column: int
    direction: str = "asc"


@dataclass(frozen=True)
class Replace:
    find: str
    replacement: str = ""
    regex: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class GridSpec:
    """What to do with a grid. Columns are named by their original index."""

    skip_rows: int = 0
    renames: dict[int, str] = field(default_factory=dict)
    clean_values: bool = False
    normalise_dates: bool = False
    percent_as_fraction: bool = False
    fill_down: tuple[int, ...] = ()
    trim_cells: bool = False
    replace: Replace | None = None
    drop_empty: bool = True
    hidden: frozenset[int] = frozenset()
    order: tuple[int, ...] = ()
    header_case: str = "none"
    search: str = ""
    dedupe: bool = False
    sort: Sort | None = None
    limit: int = 0
    transpose: bool = False

    def showing_all(self) -> GridSpec:
        return changed(self, hidden=frozenset())

    def showing_one(self, width: int) -> GridSpec:
        """All columns hidden but the first in order: a table without columns is of no use."""
        first = next((c for c in (*self.order, *range(width)) if 0 <= c < width), None)
        return changed(self, hidden=frozenset(range(width)) - {first})

    def columns_reset(self) -> GridSpec:
        return changed(self, hidden=frozenset(), renames={}, order=())

    @staticmethod
    def reset() -> GridSpec:
        """The table as it came; blank rows go all the same."""
        return GridSpec()

    def sort_toggled(self, column: int) -> GridSpec:
        """Ascending first, then descending, then unsorted; another column starts anew. A turned table is not sorted."""
        if self.transpose:
            return self
        if not self.sort or self.sort.column != column:
            return changed(self, sort=Sort(column))
        return changed(self, sort=Sort(column, "desc") if self.sort.direction == "asc" else None)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"hidden": sorted(self.hidden)})

    @staticmethod
    def from_json(text: str) -> GridSpec:
        x = json.loads(text)
        return GridSpec(**x | {
            "renames": {int(k): v for k, v in x["renames"].items()}, "hidden": frozenset(x["hidden"]), "order": tuple(x["order"]), "fill_down": tuple(x["fill_down"]),
            "sort": Sort(**x["sort"]) if x["sort"] else None, "replace": Replace(**x["replace"]) if x["replace"] else None,
        })


def header_case(name: str, style: str) -> str:
    """A header in another case; words end at lower-upper borders, before digits behind two letters, and at other signs."""
    if style == "none":
        return name
    name = name.strip()
    words = re.sub(r"([A-Za-z]{2,})([0-9])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name))
    words = re.findall(r"[0-9A-Za-z]+", words)
    if not words:
        return name
    if style == "snake":
        return "_".join(w.lower() for w in words)
    if style == "camel":
        return words[0].lower() + "".join(w[:1].upper() + w[1:].lower() for w in words[1:])
    if style == "title":
        return " ".join(w[:1].upper() + w[1:].lower() for w in words)
    return " ".join(w.upper() if style == "upper" else w.lower() for w in words)


SLOW = "the pattern backtracks too much; repeated groups that hold repetitions are the usual cause"
#: Texts on which patterns that backtrack without end show it, and the CPU seconds that a pattern may take for one.
CANARIES, CANARY_SECONDS = ("a" * 24 + "!", "ab" * 12 + "!", " " * 24 + "x", "0" * 24 + "!"), 0.04
#: Tries a pattern on each text; ends with 1 if one takes too long, with 2 if the pattern is not one of this engine's.
_TRIAL = """
import re, sys, time
pattern, seconds, *texts = sys.argv[1:]
try:
    found = re.compile(pattern)
except re.error:
    sys.exit(2)
for text in texts:
    began = time.process_time()
    found.search(text)
    if time.process_time() - began > float(seconds):
        sys.exit(1)
"""


def unsafe_pattern(pattern: str, spark: SparkSession) -> str | None:
    """Why a pattern is refused: it does not compile, or it takes too long for a short text.

    A process that can be stopped tries it first, then the engine that will run it.
    """
    try:
        compiled = spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        return f"not a valid pattern: {e}"
    try:
        if subprocess.run([sys.executable, "-c", _TRIAL, pattern, str(CANARY_SECONDS), *CANARIES], timeout=5).returncode == 1:
            return SLOW
    except subprocess.TimeoutExpired:
        return SLOW
    for text in CANARIES:
        began = time.perf_counter()
        try:
            compiled.matcher(text).find()
        except (Py4JJavaError, CapturedException):  # it runs out of stack
            return SLOW
        if time.perf_counter() - began > 5 * CANARY_SECONDS:
            return SLOW
    return None
