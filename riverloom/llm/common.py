"""Helpers that several operators share: the shared folder, lineage cuts, file access and word splitting."""

from __future__ import annotations

import io
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverloom.ship import ship

#: Words are runs of ASCII letters and digits and of all characters from U+0080 on, with A-Z lower-cased.
#: In UTF-8 a byte is enough to tell: this table lower-cases A-Z and turns every separator into a space.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORD_TABLE = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else (b if b in _KEPT else 0x20) for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    It is set here only where it is unset and driver and executors are one machine, as in tests. On a cluster an unset
    folder is an error: a folder of the driver's machine would be no shared one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return str(known.get())
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="riverloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/riverloom/{name}-{uuid.uuid4().hex}"


class _Scratches(threading.local):
    """The open ``Scratch`` blocks of a thread: queries that run side by side delete only their own tables."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCRATCH = _Scratches()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Lost executors cost nothing that was written before. Columns keep their types. Within a ``Scratch`` the table goes
    when the block ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _SCRATCH.open:
        _SCRATCH.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written within this block are deleted at its end; ``keep`` writes one that stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.paths: list[str] = []
        _SCRATCH.open.append(self.paths)
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        inner = _SCRATCH.open.pop()
        try:
            return written(df, name)
        finally:
            _SCRATCH.open.append(inner)

    def __exit__(self, *error) -> None:
        _SCRATCH.open.pop()
        for path in self.paths:
            drop_folder(self.spark, path)


def wide_rows(spark: SparkSession, rows: int = 2500) -> None:
    """Rows that hold whole texts pass to Python in smaller batches than the default, which bounds a worker's memory.

    The package is handed to workers that cannot import it yet.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def parts_for(df: DataFrame, most_bytes: int) -> int:
    """Partitions so that each has about ``most_bytes`` of the plan's estimated size, at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 10**18  # an unknown size is given as the largest number
    return max(partitions(df.sparkSession), -(-size // most_bytes) if known else 0)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(file system, path) of a folder in the shared storage; used by executors and the driver."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SharedWriter(io.RawIOBase):
    """Writes one file of the shared storage under a name of its own and moves it in place when it is complete.

    A task that is run again leaves at most an unnamed part file, never half a file under the final name.
    """

    def __init__(self, folder: str, name: str):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.final = f"{path}/{name}"
        self.part = f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.final)
        return self.final


def text_slices(column, most: int):
    """(first row, texts) of runs of an Arrow text column of about ``most`` bytes; a longer text is a run of its own.

    Only one run at a time becomes Python strings.
    """
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a, n = 0, len(column)
    while a < n:
        before = int(size[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(size, before + most, side="right")))
        yield a, column.slice(a, b - a).to_pylist()
        a = b


def release() -> None:
    """Give memory that a task no longer needs back to the system, before the worker serves another stage."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def in_blocks(rows: DataFrame, blocks: Column, id_col: str) -> DataFrame:
    """Rows of groups of so many ``blocks`` dealt to pairs of blocks by a hash: adds block, low, high.

    Every two rows of a group meet in exactly one of the pieces (group, low, high): in their own block's, or in that of
    their two blocks. A piece has two blocks at most, however large the group is.
    """
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_col), "blocks").cast("int"))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "mate")).withColumn("high", F.greatest("block", "mate"))
    return rows.drop("blocks", "mate")


def groups(batches, key: list[str]):
    """The rows of each key, as dictionaries, from Arrow batches sorted by it; a key may reach over batches."""
    held: list[dict] = []
    last = None
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            for row in batch.slice(a, 1000).to_pylist():
                now = tuple(row[c] for c in key)
                if now != last and held:
                    yield held
                    held = []
                last = now
                held.append(row)
    if held:
        yield held


def roots(n: int, i, j):
    """Of n nodes linked by pairs (i, j), the smallest number that each one reaches."""
    import numpy as np

    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def same(a: Column, b: Column) -> Column:
    """Equality that holds between nulls."""
    return a.eqNullSafe(b)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
