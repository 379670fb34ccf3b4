"""Demultiplexing of arriving read files, as a stateless stream with one static candidate table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.reads import demultiplex
from locusflow.session import prepare


def demux_stream(spark: SparkSession, source: str, schema: str, candidates: DataFrame, cutters: list[str], out: str, checkpoint: str):
    """A started query: every new Parquet file of reads under ``source`` is assigned and appended to ``out``, partitioned by sample.

    Each micro-batch is written under its own batch id, so a batch that runs again replaces its files and nothing is counted twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        demultiplex(batch, candidates, cutters).withColumn("sample", F.coalesce("sample", F.lit("unassigned"))).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demux_once(reads: DataFrame, candidates: DataFrame, cutters: list[str]) -> DataFrame:
    """status, sample, reads after streaming ``reads`` (first written as files) through the demultiplexer."""
    spark = prepare(reads.sparkSession)
    base = f"{spark.sparkContext.getCheckpointDir()}/demux-{uuid.uuid4().hex}"
    reads.write.parquet(f"{base}/in")
    demux_stream(spark, f"{base}/in", reads.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), candidates, cutters, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("status", "sample").agg(F.count("*").alias("reads"))
