"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.shipping import ship_package

#: Rows given to Python at once; with texts of a few KB this is a few MB.
BATCH_ROWS = 1000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # See the adapters: a union's children may be coalesced apart from each other.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or
    the one given to ``SparkContext.setCheckpointDir``.

    A local session that names none gets a folder of this process, removed at
    exit. Elsewhere that is an error: executors would each write to their own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="inkfathom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a later loss of executors recomputes nothing above it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows.

    Spark's own batches may hold 10,000 whole texts; they are sliced without a
    copy, so that ``f``'s working memory follows ``BATCH_ROWS``.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sliced() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BATCH_ROWS):
                    yield b.slice(at, BATCH_ROWS)

        yield from f(sliced())

    return df.mapInArrow(run, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds
