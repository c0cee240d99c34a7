"""Results that arrive in pieces: append what is new to a finished table, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def append_new(batch: DataFrame, target: str, keys: list[str]) -> None:
    """Appends the batch's rows whose key is not yet in the Parquet table at ``target``; running it again adds nothing."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates(keys)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(target)


def follow(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], files_per_batch: int = 100):  # noqa: ANN201
    """A stream over a folder of Parquet results that appends unseen keys to ``target``; it ends when all files are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    write = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.foreachBatch(lambda df, _: append_new(df, target, keys)).start()
