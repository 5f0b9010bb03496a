"""Live grounding scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panel360.operators import audit


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def start_scorecard(answers: DataFrame, out: str, checkpoint: str,
                    every: str | None = None) -> StreamingQuery:
    """Keep the daily scorecard of a stream of logged answers. A batch reads its own rows only and writes
    their counts and sums per day and role; a reader adds those of all batches up, so a row counts however
    late it comes. A batch that runs again replaces what it wrote, unless `compact_scorecard` has
    taken it up already."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id > _compacted(batch.sparkSession, out):
            _save(audit.scorecard_partials(batch), f"{out}/partials/batch={batch_id}")

    writer = answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if every is None else writer.trigger(
        processingTime=every)
    return timed.start()


def _known(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _compacted(spark: SparkSession, out: str) -> int:
    """The last batch that the newest compaction took up, -1 before the first."""
    if not _known(spark, f"{out}/compactions"):
        return -1
    return spark.read.schema("batches LONG, upto INT").parquet(f"{out}/compactions").agg(
        F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def _partials(spark: SparkSession, out: str) -> DataFrame:
    """What the newest compaction holds and the batches behind it."""
    last = _compacted(spark, out)
    schema = "day DATE, asked_role STRING, answers LONG, grounded_answers LONG, citations LONG, " \
             "cited_answers LONG, latency_ms DECIMAL(38, 6), timed_answers LONG, batch INT"
    new = spark.read.schema(schema).parquet(f"{out}/partials").filter(F.col("batch") > last)
    if last < 0:
        return new
    return new.unionByName(spark.read.schema(schema).parquet(f"{out}/days/upto={last}"),
                           allowMissingColumns=True)


def compact_scorecard(spark: SparkSession, out: str) -> None:
    """Add the batches so far up to one row per day and role. Readers change over when the row in
    `compactions`, written last, is there; the intake may run meanwhile. The batches taken up are
    no longer read and may be removed, as may older `days`."""
    rows = _partials(spark, out)
    batches = spark.read.schema("batch INT").parquet(f"{out}/partials").agg(F.max("batch")).first()[0]
    last = _compacted(spark, out)
    if batches is None or batches <= last:
        return
    taken = rows.filter(F.col("batch").isNull() | (F.col("batch") <= batches))
    _save(audit.added_partials(taken), f"{out}/days/upto={batches}")
    _save(spark.range(1).select(F.lit(batches - last).cast("long").alias("batches")),
          f"{out}/compactions/upto={batches}")


def read_scorecard(spark: SparkSession, out: str) -> DataFrame:
    """Every day and role over all batches."""
    return audit.scorecard_of(_partials(spark, out))
