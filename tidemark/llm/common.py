"""Helpers shared by the training-data operators.

Intermediate results that are read more than once are written as Parquet in
the folder that the cluster names in ``spark.checkpoint.dir``, which driver
and executors share.  A lost executor therefore never loses one of them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all tasks run on this machine."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as a struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, as the contracts ask; ``lower`` also folds accented letters."""
    return F.translate(c, UPPER, LOWER)


#: Bytes that go to a Python worker at once, whatever the number or length of the rows.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in bytes: what a task holds does not grow with the texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtpKMGTP]?)[bB]?\s*", conf.get(name)).groups()
    if int(number) << 10 * " kmgtp".index(unit.lower() or " ") > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
