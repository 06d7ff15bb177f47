"""Shared storage and small helpers that all operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in tests, a master inside this process gets a folder of its own; a cluster gets an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="loomstone-")
        shared_dir.own = where
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empties stored tables that nothing will read again: an empty table takes the place of each."""
    for df in tables:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df.stored_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: list[Callable[[], None]] = []
#: Rows of an Arrow batch that a session's tasks send to their workers, at most: texts of a batch are held on both sides at once.
ARROW_ROWS = 2048


def kept(make: Callable) -> Callable:
    """For what is costly to make: a worker has one for each argument and keeps it from task to task, until a task comes that doesn't say ``keep``."""
    made = lru_cache(4)(make)
    _KEPT.append(made.cache_clear)
    return made


def let_go() -> None:
    for clear in _KEPT:
        clear()


def map_batches(df: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str, rows: int = 512, keep: bool = False) -> DataFrame:
    """mapInArrow with plain lists: the function gets an iterator of column dicts of at most ``rows`` rows and gives column dicts in the order of ``schema``.

    Without ``keep`` a worker first drops what tasks of other operators left in it (see ``kept``). The session's Arrow batches are cut to ``ARROW_ROWS`` rows if they are longer.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= ARROW_ROWS:
        df.sparkSession.conf.set(setting, str(ARROW_ROWS))
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    names, to = df.columns, to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            let_go()

        def slices():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(names)}

        for out in function(slices()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in to], schema=to)

    return df.mapInArrow(run, kinds)
