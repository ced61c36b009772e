"""Written tables that cut the lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder
    will do in local mode; on a cluster executors would not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veiltab-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders by the columns `by` if any are given."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(df: DataFrame) -> list:
    """The Hadoop paths that hold the files of df, a table made by written()."""
    return [df.sparkSession._jvm.org.apache.hadoop.fs.Path(uri) for uri in {os.path.dirname(x) for x in df.inputFiles()}]


def forget(df: DataFrame) -> None:
    """Removes the files of a table made by written() once nothing reads it any more."""
    for path in folders(df):
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files that df, a table made by written(), reads."""
    return sum(path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength() for path in folders(df))


class Scratch:
    """Tables that are needed while one result is made."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables ahead of the end."""
        for table in tables:
            self.tables = [t for t in self.tables if t is not table]
            forget(table)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Removes what was written through it at the end, after an error too."""
    own = Scratch()
    try:
        yield own
    finally:
        for table in own.tables:
            forget(table)
