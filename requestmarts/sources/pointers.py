"""Which build readers follow: versioned pointer files in the folder of the builds.

A pointer is a JSON object with the build's folder, in a file named by its version and a
name of its own: no file is ever written twice, and publishers at the same moment each
leave theirs. All readers take the last whole one by name; any session that can read
the folder finds the build, with or without a metastore.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "published"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, out: str) -> list[str]:
    """Pointer files, the oldest first."""
    path, files = _path(spark, out.rstrip("/"), FOLDER)
    if not files.exists(path):
        return []
    names = (status.getPath().getName() for status in files.listStatus(path))
    return sorted(name for name in names if name[0].isdigit())


def publish(spark: SparkSession, out: str, build: str) -> str:
    """Point readers of ``out`` to a build; returns the pointer's name."""
    version = max((int(name.split("-")[0]) for name in _names(spark, out)), default=0) + 1
    name = f"{version:010d}-{uuid.uuid4().hex}"
    path, files = _path(spark, out.rstrip("/"), FOLDER, name)
    stream = files.create(path, False)
    stream.write(bytearray(json.dumps({"build": build}).encode()))
    stream.close()
    return name


def published(spark: SparkSession, out: str) -> DataFrame:
    """(name, build) of every whole pointer."""
    text = spark.read.option("wholetext", True).text(f"{out.rstrip('/')}/{FOLDER}")
    name = F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    build = F.from_json("value", "build string")["build"]
    return text.select(name.alias("name"), build.alias("build")).where("build is not null")


def current(spark: SparkSession, out: str) -> str | None:
    """The published build of a folder; None if there is none."""
    if not _names(spark, out):
        return None
    newest = published(spark, out).orderBy(F.desc("name")).first()
    return newest["build"] if newest else None
