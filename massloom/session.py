"""Session helpers: configuration, the shared working folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_scopes: list[str] = []


def get_spark(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects.

    On a cluster use the session that is there; nothing below depends on these values.
    """
    n = os.cpu_count() if cpus == "*" else int(cpus)
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{n}]").config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a temporary folder is made, and removed at exit.
    """
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="massloom-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/massloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the application's scratch folder that nothing has used."""
    return "/".join([scratch_dir(spark), *_scopes, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside of the block go at its end; write what is to stay to a path made before."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    path = "/".join([scratch_dir(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        delete_path(spark, path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` but stays columnar, so later reads prune columns,
    and it survives the loss of any executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table that ``materialize`` and operators left in this application's scratch folder; frames read from them end.

    What other applications have there stays, as does an index or shards at a path of the caller's own.
    """
    delete_path(spark, scratch_dir(spark))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each context.

    Nothing is sent where PYTHONPATH, which workers inherit, has it.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_massloom_shipped", False) or os.path.dirname(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    tmp = os.path.realpath(tempfile.mkdtemp(prefix="massloom-zip-"))  # Spark serves the file from here until the end
    atexit.register(shutil.rmtree, tmp, True)
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, "massloom"), "zip", os.path.dirname(root), os.path.basename(root)))
    sc._massloom_shipped = True
