"""File listings that executors make, folder by folder.

Each round lists the folders found by the round before, in tasks, and writes
what it finds; only the number of folders comes to the driver.  So neither a
store with very many files nor a deep tree is held in one place; a single
folder's entries pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import ensure_checkpoint_dir, scratch_path, ship_package

KNOWN_SCHEMES = {"", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss"}
CHUNK = 10_000


def can_walk(root: str) -> bool:
    """Whether tasks can list the store of ``root`` themselves."""
    return urlsplit(root).scheme in KNOWN_SCHEMES


def _open(root: str) -> tuple[fs.FileSystem, str]:
    if urlsplit(root).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(root).path
    return fs.FileSystem.from_uri(root)


def _hidden(name: str) -> bool:
    """Names that Spark's own file readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list(root: str):
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(root)
        base = base.rstrip("/")
        for b in batches:
            for folder in b["path"]:
                entries = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base or "/"))
                for i in range(0, len(entries), CHUNK):
                    part = [e for e in entries[i:i + CHUNK] if not _hidden(e.base_name)]
                    yield pd.DataFrame({"path": [f"{folder}/{e.base_name}" if folder else e.base_name for e in part],
                                        "folder": [e.type == fs.FileType.Directory for e in part]})
    return fn


def walk_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path`` of every file under ``root``, relative to it.  A missing root is an error."""
    store, base = _open(root)
    if store.get_file_info(base.rstrip("/") or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    schema = "path string, folder boolean"
    folders = spark.createDataFrame([("",)], "path string")
    levels, n = [], 1
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        levels.append(scratch_path(spark, "listing"))
        folders.repartition(tasks).mapInPandas(_list(root), schema).write.parquet(levels[-1])
        folders = spark.read.schema(schema).parquet(levels[-1]).filter("folder").select("path")
        n = folders.count() if recursive else 0
    return spark.read.schema(schema).parquet(*levels).filter(~F.col("folder")).select("path")
