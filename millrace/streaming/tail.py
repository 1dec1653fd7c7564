"""The dialect over files that keep arriving.

A folder of Parquet files read as a stream is a table like any other, so a query without
sorting or ranking runs on it unchanged; windowed counts add a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.engine import Engine


def stream_table(engine: Engine, name: str, folder: str, schema=None, files_per_batch: int = 100) -> DataFrame:
    """Register a folder as a streaming table; its schema is that of the files there, unless given."""
    schema = schema or engine.spark.read.parquet(folder).schema
    df = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    engine.register_table(name, df)
    return df


def counts_by_window(df: DataFrame, time: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows per window of time and key; rows later than ``late`` are left out."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write results as Parquet files, each batch once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
