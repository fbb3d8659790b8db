"""Shared plumbing of the training-data operators: tables in the shared folder, input columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, types: dict[str, str] = DOCUMENT_COLUMNS) -> DataFrame:
    """Only the named columns, in their documented types.

    Further columns are left out before anything else runs, so that their names
    can't clash with an operator's own; a missing column reads as null.
    """
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (df[f"`{have[n]}`"] if n in have else F.lit(None)).cast(types.get(n, "string")).alias(n)
            for n in names
        ]
    )


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function of a task, which gives freed memory back to the system at its end.

    Python workers wait for their next task with all they ever took, next to those of other stages.
    """

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def utf8_length(text: str | Column) -> Column:
    """UTF-8 bytes of a text, 0 if null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


HOT_SHARE = 1_000


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], members: str, total: int, how: str = "inner") -> DataFrame:
    """Rows joined ("inner" or "left") with facts, which has one row a key and in ``members`` how many rows have that key.

    Keys with more than a thousandth of the ``total`` rows, of which there are under a thousand, are
    broadcast, so that their rows stay where they are and no task meets all rows of one; the others are joined as usual. Facts
    should be a written table, as it is read more than once.
    """
    hot = F.broadcast(facts.where(F.col(members) * HOT_SHARE > total))
    cold = facts.where(F.col(members) * HOT_SHARE <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs run in here, a task and its Python worker hold 8 MB of rows at a time (a longer row goes alone)."""
    before = spark.conf.get(_BATCH)
    told = before.rstrip("b")
    if told.isdigit() and int(told) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_local: dict[str, str] = {}  # the folder of this process where the session names none


class Workspace:
    """Intermediate tables of one operator call, in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session; where it is unset, a session in
    local mode gets a folder of this machine, and any other an error, as its executors would
    not share one. ``keep`` writes a table and reads it back,
    which cuts the lineage with data that outlives any executor; ``result`` does
    so for the last table and deletes the others.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not root:
            _local.setdefault("root", tempfile.mkdtemp(prefix="tagloom-"))
            root = _local["root"]
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._tables: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self._tables.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def adopt(self, name: str) -> None:
        """Count a table that the caller wrote into the folder among the intermediate ones."""
        self._tables.append(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete an intermediate table that nothing reads any more."""
        path = f"{self.root}/{name}"
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self._tables.remove(path)

    def result(self, df: DataFrame) -> DataFrame:
        old = list(self._tables)
        out = self.keep(df, "result")
        for path in old:
            self.drop(path.rsplit("/", 1)[1])
        return out
