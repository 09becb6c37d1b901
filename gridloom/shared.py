"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir; where that is unset, in a temporary folder if all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def put_together(spark: SparkSession, parts: str, path: str) -> None:
    """One file out of the parts of a written folder in the order of their names, which go: their bytes pass through a stream 64 KB at a time."""
    jvm, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder, target = jvm.fs.Path(parts), jvm.fs.Path(path)
    fs = folder.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    for part in sorted((f.getPath() for f in fs.listStatus(folder)), key=lambda p: p.getName()):
        if part.getName().startswith("part-"):
            data = fs.open(part)
            jvm.io.IOUtils.copyBytes(data, out, 1 << 16, False)
            data.close()
    out.close()
    fs.delete(folder, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows out of a scratch table, for what is dear to work out and read more than once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def head_of(spark: SparkSession, path: str, n: int) -> str:
    """The first ``n`` bytes of the first file that is not empty, as text."""
    first = spark.read.format("binaryFile").load(path).where("length > 0").agg({"path": "min"}).first()[0]  # one row
    if first is None:
        return ""
    at = spark._jvm.org.apache.hadoop.fs.Path(first)
    data = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    head = bytes(data.readNBytes(n)).decode(errors="ignore")
    data.close()
    return head
