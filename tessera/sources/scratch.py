"""Tables that are written once and read again: the shared scratch folder, and a corpus built once per application."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, dict[str, DataFrame]] = {}
#: Inputs below so many bytes per core are dealt out anew before costly expressions.
SMALL = 64 << 20


def scratch_root(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names; a local one only if driver and executors are one process, else none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root and (sc.master == "local" or sc.master.startswith("local[")):
        if not getattr(sc, "_tessera_tables", None):
            sc._tessera_tables = tempfile.mkdtemp(prefix="tessera-tables-")
        root = sc._tessera_tables
    return root.rstrip("/") if root else None


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and latest change of a table: what tells that it is still the same."""
    p, fs = _file_system(spark, path)
    status = fs.getFileStatus(p)
    files = [status] if status.isFile() else [f for f in fs.listStatus(p) if f.isFile()]
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def spread(df: DataFrame, size: int) -> DataFrame:
    """A small input (``size`` bytes) in as many partitions as there are cores; larger ones stay as their files part them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SMALL * cores else df


def kept(spark: SparkSession, key: tuple, tables: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables written once per application and ``key`` and read back. Without a shared folder they stay plans."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        root = scratch_root(spark)
        made = tables()
        if root is not None:
            for name, df in made.items():
                path = f"{root}/tessera-{name}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                atexit.register(_remove, spark, path)
                made[name] = spark.read.schema(df.schema).parquet(path)
        _KEPT[key] = made
    return _KEPT[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p, fs = _file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the session has ended
        pass
