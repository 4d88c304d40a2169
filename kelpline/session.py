"""Session defaults and the few run-time helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kelpline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings given elsewhere win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    Only where ``spark.checkpoint.dir`` is unset and no folder was chosen yet (local tests) is a
    folder of this machine used.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "kelpline-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, *by: str) -> DataFrame:
    """Write a table into the shared folder, in parts by columns of few values if any, without a shuffle, and read it back."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row-local work at least one partition per core.

    A scan that already has that many splits (any large input) is left alone, so this shuffles only
    inputs too small to have been split by the file reader. A frame that holds exchanges is left alone too: asking for
    its partitions would run them.
    """
    if "Adaptive" in df._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def spread_small(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a shuffled frame all cores, whatever its bytes.

    Adaptive execution merges partitions that are small in bytes, although each row may cost much or explode; a
    round-robin exchange with a fixed number of partitions is left alone.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """As ``spread_small``, with equal keys in one place."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by a key without nulls as tables that don't end within the rows of one value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pc.run_end_encode(batch.column(key)).run_ends.to_pylist()
        last = new[-2] if len(new) > 1 else 0
        if held and not last and batch.column(key)[0] == held[-1].column(key)[-1]:
            held.append(batch)
            continue
        if last or held:
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
