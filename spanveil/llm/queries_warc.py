"""Query op10 over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.warc import find_captures, new_archive, plan_records, read_records, write_archives, write_index
from spanveil.storage import cut, remove, table


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, index the archives, and read every record back through the index."""
    folder, pages = new_archive(spark), table(spark, sf_dir, "pages")
    captures = write_archives(plan_records(pages, least=0), folder)
    upper = write_index(captures, folder)
    found = cut(read_records(find_captures(pages, upper, folder), folder))
    remove(spark, folder)  # the query's own archive; its rows are kept
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
