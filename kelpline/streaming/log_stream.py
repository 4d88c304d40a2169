"""The scan log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream of log rows, the time of arrival with a zone as watermarks need it."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return s.withColumn("received_at", F.col("received_at").cast("timestamp"))


def delivered_once(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows without those delivered again with the same sid within the watermark."""
    return stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["sid"])


def windowed_counts(stream: DataFrame, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Scans, matched and unmatched terms of each window of arrival."""
    return stream.withWatermark("received_at", late).groupBy(F.window("received_at", size).alias("w")).agg(F.count("*").alias("n"), F.sum("n_matched").alias("matched"), F.sum("n_unmatched").alias("unmatched")).select("w.start", "n", "matched", "unmatched")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "7 days", by: str = "device") -> DataFrame:
    """Runs of scans with no longer gap between them."""
    return stream.withWatermark("received_at", late).groupBy(F.session_window("received_at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, "w.start", "w.end", "n")


def running_misses(stream: DataFrame) -> DataFrame:
    """(term, n): the running count of each unmatched term, kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(int(b["c"].sum()) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"term": [key[0]], "n": [n]})

    terms = stream.select(F.explode("miss").alias("term"), F.lit(1).alias("c"))
    return terms.groupBy("term").applyInPandasWithState(update, "term string, n long", "n long", "update", "NoTimeout")
