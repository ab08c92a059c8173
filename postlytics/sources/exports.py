"""Round-trip exports: Spark writes the posts table as a platform-style CSV
export into the shared checkpoint folder, so the loader queries read files
whose size grows with the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postlytics.session import checkpoint_dir
from postlytics.sources.csv_export import write_messy_export, write_mixed_exports
from postlytics.sources.fixtures import posts_from_events

_WRITTEN: dict[tuple, str] = {}


def table_version(spark: SparkSession, sf_dir: str, name: str = "events") -> tuple:
    """Files, sizes and times of a table: what is derived from it is only used again while they stay the same."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
             .load(f"{sf_dir.rstrip('/')}/{name}.parquet").select("path", "length", "modificationTime"))
    row = files.agg(F.count("path"), F.sum("length"), F.max("modificationTime"),
                    F.sum(F.crc32(F.concat_ws("|", "path", "length", "modificationTime").cast("binary")))).first()
    return (spark.sparkContext.applicationId, sf_dir, *row)


def export_from_tables(spark: SparkSession, sf_dir: str) -> str:
    """Folder of CSV part files derived from ``events``, as many as the data has partitions (written once per session)."""
    key = table_version(spark, sf_dir)
    if key not in _WRITTEN:
        base = checkpoint_dir(spark).rstrip("/")
        path = f"{base}/exports/{uuid.uuid4().hex}"
        write_messy_export(posts_from_events(spark, sf_dir), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def mixed_exports_from_tables(spark: SparkSession, sf_dir: str) -> str:
    """Folder of exports of different making derived from ``events`` (written once per session)."""
    key = (*table_version(spark, sf_dir), "mixed")
    if key not in _WRITTEN:
        path = f"{checkpoint_dir(spark).rstrip('/')}/exports/{uuid.uuid4().hex}"
        write_mixed_exports(posts_from_events(spark, sf_dir), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


_POSTS: dict[tuple, str] = {}


def materialized_posts(spark: SparkSession, sf_dir: str):
    """The events-derived posts table, written once per session as Parquet in the
    shared checkpoint folder and read back (scans then prune and push down)."""
    key = table_version(spark, sf_dir)
    if key not in _POSTS:
        base = checkpoint_dir(spark).rstrip("/")
        path = f"{base}/posts/{uuid.uuid4().hex}"
        posts_from_events(spark, sf_dir).write.mode("overwrite").parquet(path)
        _POSTS[key] = path
    return spark.read.parquet(_POSTS[key])
