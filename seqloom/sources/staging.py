"""Tables in the folder that all executors share."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _one_machine() -> str:
    return tempfile.mkdtemp(prefix="seqloom-")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names; in one of this machine only where that is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(named or _one_machine()).rstrip('/')}/seqloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lost executors cost no work before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def kept_at(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written there first if no run before has finished it."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of staged() that nothing reads any more."""
    _delete(df.sparkSession, df._seqloom_path)


def _delete(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


class ArrayState:
    """Arrays and plain values under a path that driver and executors share, the latest ones only.

    Each save() is a table of its own; those before it go once it is complete, so that a driver lost
    meanwhile finds one of both.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _saved(self) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(top)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def load(self) -> dict | None:
        if not (numbers := self._saved()):
            return None
        held = bytes(self.spark.read.parquet(f"{self.path}/{numbers[-1]:09d}").first()["held"])
        with np.load(io.BytesIO(held), allow_pickle=False) as arrays:
            return {k: v.item() if v.shape == () else v.tolist() if k == "history" else v for k, v in arrays.items()}

    def save(self, held: dict) -> None:
        before = self._saved()
        buffer = io.BytesIO()
        np.savez(buffer, **held)
        new = before[-1] + 1 if before else 0
        self.spark.createDataFrame([(bytearray(buffer.getvalue()),)], "held binary").write.mode("overwrite").parquet(f"{self.path}/{new:09d}")
        for k in before:
            _delete(self.spark, f"{self.path}/{k:09d}")
