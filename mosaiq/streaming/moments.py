"""Running statistics of feature vectors over a stream of small batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_moments(stream: DataFrame, column: str = "f") -> DataFrame:
    """(pos, n, mean, var) so far; write it in ``complete`` or ``update`` mode. The state is one mergeable buffer
    for each position, whatever the number of rows."""
    x = F.col("x").cast("double")
    return stream.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.count("x").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def feature_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a growing folder of feature tables, some files at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
