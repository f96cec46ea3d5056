"""Files that tasks open themselves, by the paths that Spark gives, and listings of folder trees by tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

#: Spark's names of object stores by those of Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


def uri(path: str) -> str:
    """A path of Spark's as Arrow writes it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it. A store that Arrow has no file system for is an error that names the scheme; hdfs and viewfs need Hadoop's native library on the executors."""
    target = uri(path)
    try:
        if re.match("(hdfs|viewfs):", target):
            return pyarrow.fs.HadoopFileSystem.from_uri(target), "/" + re.sub("^[a-z]+://[^/]*/?", "", target)
        if "://" not in target:
            return pyarrow.fs.LocalFileSystem(), target
        return pyarrow.fs.FileSystem.from_uri(target)
    except (pyarrow.ArrowInvalid, OSError) as e:
        raise ValueError(f"no file system for {target.split(':')[0]}: {e}") from e


_LISTING = "path string, folder boolean, bytes long, modified timestamp"


def _entries(folders: DataFrame) -> DataFrame:
    """What lies right in each folder (path)."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                system, inside = opened(path)
                root = path.rstrip("/")
                found = system.get_file_info(pyarrow.fs.FileSelector(inside, recursive=False))
                rows = [(f"{root}/{i.base_name}", i.type == pyarrow.fs.FileType.Directory, i.size, i.mtime.replace(tzinfo=None) if i.mtime else None) for i in found]
                yield pd.DataFrame(rows, columns=["path", "folder", "bytes", "modified"])

    return folders.select("path").mapInPandas(look, _LISTING)


def listed(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path, folder, bytes (null for folders) and modified (UTC) of all that lies below root, which must be there.

    Tasks look into the folders level by level; each level is a stored table, so that no list is on the driver, which counts the folders left. Names that begin with a dot or an
    underscore are left out with all below them unless hidden.
    """
    parts = spark.sparkContext.defaultParallelism
    level, levels = spark.createDataFrame([(root.rstrip("/"),)], "path string"), []
    while True:
        found = _entries(level)
        if not hidden:
            found = found.where(~F.regexp_extract("path", "([^/]+)$", 1).rlike("^[._]"))
        levels.append(stored(found, "listing"))
        level = levels[-1].where("folder").select("path")
        if level.isEmpty():
            break
        level = level.repartition(parts, "path")
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out
