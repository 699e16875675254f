"""Folder, checkpoint and Arrow helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, which a cluster must name.

    Only a local master, where driver and executors are one process, gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir().rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner waits for the driver's garbage collection, which an iteration of many small jobs
    may not bring about for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: columnar, and safe from lost executors."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def map_batches(df: DataFrame, rows: Callable[[list[list]], list[list]], schema: str | StructType, binary: tuple[str, ...] = (), most: int = 2048) -> DataFrame:
    """mapInArrow over lists: rows gets the columns of a batch and returns those of the result.

    Columns named in binary come as bytes (UTF-8 of strings), which saves decoding them. rows gets
    at most ``most`` rows at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                columns = [
                    (c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()) if n in binary and not pa.types.is_binary(c.type) else c).to_pylist()
                    for n, c in zip(part.schema.names, part.columns, strict=True)
                ]
                out = rows(columns)
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text, modulo a number: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
