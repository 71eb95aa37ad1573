"""Shared folders, intermediate tables and text helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once a session's context: their Python may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_sequora_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="sequora-"), "sequora.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    out.write(at, os.path.join("sequora", os.path.relpath(at, top)))
    sc.addPyFile(archive)
    sc._sequora_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode a fresh one if that is unset."""
    sc = spark.sparkContext
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sequora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scratch in Scratch.open_:
        scratch.paths.append(path)
    return path


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded(df: DataFrame, name: str, limit: int = 1_000_000) -> DataFrame:
    """A narrow table, written and read again; to be broadcast if it has at most ``limit`` rows."""
    out, _ = materialise(df, name)
    return F.broadcast(out) if out.count() <= limit else out


class Scratch:
    """Forgets nothing that was written while it is open: ``drop`` deletes it all but for what is still needed.

    Tables that a lazy result reads stay until its caller drops them, so the operators don't delete them themselves.
    """

    open_: list["Scratch"] = []

    def __enter__(self) -> "Scratch":
        self.paths: list[str] = []
        Scratch.open_.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open_.remove(self)

    def drop(self, spark: SparkSession, *needed: str) -> None:
        for path in self.paths:
            if path not in needed:
                drop_path(spark, path)
        self.paths = [p for p in self.paths if p in needed]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """The name, or one with underscores in front that none of the columns has (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def release() -> None:
    """Give freed memory back to the machine: Python workers are used again by later stages and keep what they took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_held: list = ["", None]


def hold(name: str = "", forget=None) -> None:
    """Say whose tables this Python worker keeps from now on: those of another operator are forgotten.

    Workers outlive an operator, so that a pipeline would else hold the tables of all its stages at once.
    """
    if _held[0] == name:
        return
    if _held[1]:
        _held[1]()
    _held[:] = name, forget
    release()


def in_slices(batches, rows: int = 4000, limit: int = 3 << 20):
    """Arrow batches cut so that a slice has few rows and, but for a single row, few bytes of strings.

    After the last one, freed memory is given back.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total = starts_of(sizes)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
    release()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: (index of each word into the distinct words, distinct words, words per text)."""
    parts = pc.ascii_split_whitespace(texts)
    counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out
