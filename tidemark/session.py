"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Series are TIMESTAMP_NTZ holding UTC; arithmetic on instants needs a session without daylight saving.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # looking up the caller of every column takes longer than planning
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once for all that reads it, where the cluster names a folder for checkpoints."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
