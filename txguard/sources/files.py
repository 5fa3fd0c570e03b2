"""File counterparts of the topics: the same columns from and to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from txguard.schemas import LABELLED_TRANSACTION

MESSAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType = MESSAGE, format: str = "parquet", files_per_batch: int = 1
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_batch(
    spark: SparkSession, path: str, schema: T.StructType = LABELLED_TRANSACTION, format: str = "parquet"
) -> DataFrame:
    return spark.read.schema(schema).format(format).load(path)


def alert_writer(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> DataStreamWriter:
    """A writer of rows to files, exactly once across restarts from the same checkpoint."""
    return (
        df.writeStream.format(format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A parquet table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
