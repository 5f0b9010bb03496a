"""Document intake: one file is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panel360.functions import html_to_text, regex_group

NO_AGE_LIMIT = "36500d"


def _named(raw: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_replace(path, "^.*/", "").alias("file_name"),
                      path.alias("stage_path"), F.col("value").alias("doc_text"),
                      F.col("_metadata.file_modification_time").alias("modified_at"))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Whole-file scan: file_name, stage_path, doc_text."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return _named(raw).drop("modified_at")


def stream_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """The same scan over files as they arrive, with the file time as `modified_at`. No file is too old
    to be taken: by default the source passes over those a week older than the newest."""
    raw = (spark.readStream.format("text").option("wholetext", True)
           .option("maxFileAge", NO_AGE_LIMIT).option("pathGlobFilter", pattern).load(folder))
    return _named(raw)


def parse_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Second layout: title from the first <h1>, else <title>, and the visible text."""
    title = F.coalesce(regex_group(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>"),
                       regex_group(F.col(html), r"(?is)<title[^>]*>(.*?)</title>"))
    return pages.select(key, title.alias("title"), html_to_text(F.col(html)).alias("body_text"))
