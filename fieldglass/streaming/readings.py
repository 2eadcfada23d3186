"""Readings as they arrive: the same gates over micro-batches of recorded JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldglass.operators.resolve import Gates, readings
from fieldglass.sources.readers import read_native


def native_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (key, native) from JSON lines that land in a folder."""
    return spark.readStream.schema("key string, native string").json(path)


def write_readings(source: DataFrame, catalog: DataFrame, path: str, checkpoint: str, gates: Gates = Gates()) -> StreamingQuery:
    """Resolves each micro-batch and writes it; a batch that runs again replaces its own rows.

    A photo is resolved by itself, so batches need no state. Rows of one batch
    go to a folder of its number.
    """

    def resolve(batch: DataFrame, number: int) -> None:
        readings(read_native(batch), catalog, gates).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trusted(readings_: DataFrame, field: str) -> DataFrame:
    """Rows of one field that may be kept: those without a reason."""
    return readings_.where(F.col(f"{field}.reason").isNull())
