"""Tables that cut lineage, kept in the folder the cluster names in ``spark.checkpoint.dir``.

A lost executor never loses them: they are ordinary Parquet files on the shared store.
Where the setting is absent (tests, a laptop) a temporary folder stands in.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.scratch import shared_root, write_table


class Workspace:
    """A folder of written tables for one run of one operator."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return write_table(df, self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than that many and one."""
    return df.limit(max_rows + 1).count() <= max_rows
