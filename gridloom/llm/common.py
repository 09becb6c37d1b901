"""What the operators share: scratch tables in the cluster's shared folder, and Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; one longer text is taken whole.
CHUNK_BYTES = 1 << 19
#: Items of lists that it takes at once.
CHUNK_ITEMS = 1 << 18


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one if all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    return _own[app]


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a rerun of what came before.

    ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.held: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.held.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Removes all that this has kept but ``tables``: what an operator that returns them leaves."""
        for path in self.held - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.held.discard(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` of so many rows in tasks of about ``each`` of them; where it has fewer tasks already it stays as it is."""
    return df.coalesce(max(1, -(-rows // each)))


def large_text(column: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets and empty strings for nulls."""
    return column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of the text column each."""
    lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def by_lists(batch: pa.RecordBatch, lists: str, limit: int = CHUNK_ITEMS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` items of a column of lists each; one longer list is taken whole."""
    sizes = pc.list_value_length(batch.column(lists)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    cuts = [0, *(i for i in range(1, len(sizes)) if sizes[i] // limit != sizes[i - 1] // limit), len(sizes)]
    for i, j in pairwise(cuts):
        if j > i:
            yield batch.slice(i, j - i)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str | None = None, lists: str | None = None, limit: int | None = None) -> Callable:
    """A mapInArrow function out of one on record batches, cut to bounded bytes where ``text`` is named, to bounded items where ``lists`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, limit or CHUNK_BYTES) if text else by_lists(batch, lists, limit or CHUNK_ITEMS) if lists else [batch]:
                out = f(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()  # workers are used again, by other stages too

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the classifiers."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % n
