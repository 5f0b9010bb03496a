"""Documents extracted once each, as they arrive, into metadata, chunk and signal tables and a text index.

Every micro-batch owns one partition of each table and one segment of the index. Its row in the index's
`commits` is written last: readers take committed batches only, so between two writes of a batch, or
after a stop there, all tables still show the state before it. A batch that runs again replaces what
it wrote; one that was committed is left as it is.

Every delivered file is kept, however old its time stamp; a reader sees the newest version of each
document id. The index holds the chunks of newest versions: a revision buries those of the version
before, a version older than the one known is never indexed. The file source takes a path once, so a
revision must come under a new file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panel360.operators import docs, index
from panel360.sources.documents import stream_documents

TABLES = ("doc_metadata", "doc_chunk", "doc_signal")
LABEL, TEXT = "citation_label", "chunk_text"


def _newest(metadata: DataFrame, *ties: str) -> DataFrame:
    """One row per document id: the latest file time, of equals the last by `ties`."""
    columns = [c for c in metadata.columns if c != "doc_id"]
    return metadata.groupBy("doc_id").agg(F.max_by(
        F.struct(*columns), F.struct("modified_at", *ties)).alias("_row")).select("doc_id", "_row.*")


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _batches(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """The committed rows of a table with their batch."""
    known = sorted(index.committed(spark, f"{out}/index"))
    if not known:
        return None
    return spark.read.option("basePath", f"{out}/{table}").parquet(
        *[f"{out}/{table}/batch={b}" for b in known])


def ingest_documents(spark: SparkSession, folder: str, out: str, checkpoint: str,
                     every: str | None = "1 hour", pattern: str = "*.md") -> StreamingQuery:
    """Start the intake. `every` is the longest time the index may lag behind; None takes what is
    there and stops. The metadata of a batch is written first and the other tables read it, so the
    patterns run once per document."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def part(table: str) -> str:
            return f"{out}/{table}/batch={batch_id}"

        if batch_id in index.committed(spark, f"{out}/index"):
            return
        # Of several versions in one batch the newest; between batches the reader decides.
        newest = _newest(batch, "file_name")
        _save(newest, part("doc_metadata"))
        metadata = spark.read.schema(newest.schema).parquet(part("doc_metadata"))
        chunks = docs.doc_chunks(metadata)
        _save(chunks, part("doc_chunk"))
        _save(docs.safety_flags(docs.doc_signals(metadata)), part("doc_signal"))
        stored = spark.read.schema(chunks.schema).parquet(part("doc_chunk"))
        dead, known = None, _batches(spark, out, "doc_metadata")
        if known is not None:
            mine = metadata.select("doc_id", F.col("modified_at").alias("_mine"))
            before = _newest(known.select("doc_id", "modified_at", "batch").join(
                mine.select("doc_id"), "doc_id", "left_semi"), "batch").withColumnRenamed("batch", "of")
            versions = mine.join(before, "doc_id")
            late = versions.filter("modified_at > _mine")
            stored = stored.join(late.select("doc_id"), "doc_id", "left_anti")
            old = versions.filter("modified_at <= _mine").select("doc_id", F.col("of").alias("batch"))
            dead = _batches(spark, out, "doc_chunk").join(old, ["doc_id", "batch"]).select(
                LABEL, F.col("batch").alias("of"))
        index.write_segment(stored, f"{out}/index", batch_id, LABEL, TEXT, index.INDEX_ATTRIBUTES, dead)
        index.commit(spark, f"{out}/index", batch_id)

    files = docs.doc_metadata(stream_documents(spark, folder, pattern), keep=("modified_at",))
    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if every is None else writer.trigger(
        processingTime=every)
    return timed.start()


def read_ingested(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of the newest committed version of every document."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    known = _batches(spark, out, "doc_metadata")
    if known is None:
        raise ValueError(f"no committed batch under {out}")
    versions = _newest(known, "batch")
    if table == "doc_metadata":
        return versions
    rows = _batches(spark, out, table)
    return rows.join(versions.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select(
        rows.columns)


def search_ingested(spark: SparkSession, out: str, queries: DataFrame, k: int, **options) -> DataFrame:
    """Top k chunks per query of what has been taken in up to the last committed batch; `options` as
    for `index.search_index`."""
    return index.search_index(spark, f"{out}/index", queries, k, LABEL, TEXT, **options)


def compact(spark: SparkSession, out: str, target: str) -> None:
    """Write the newest versions to the tables of a new folder as one batch, the last committed one,
    and the index as one segment; the intake may go on there."""
    known = index.committed(spark, f"{out}/index")
    if not known:
        raise ValueError(f"no committed batch under {out}")
    for table in TABLES:
        _save(read_ingested(spark, out, table).drop("batch"), f"{target}/{table}/batch={max(known)}")
    index.merge(spark, f"{out}/index", f"{target}/index", LABEL, max(known))
