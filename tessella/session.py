"""Session factory, table access and the shared folder in which plans cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: What a cluster session should have; tests lower the partition count.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tessella")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "12g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)  # what a query does with the table may need this package on the workers
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: every executor gets it as a zip, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    staged = Path(SparkFiles.getRootDirectory()) / f"staged-{uuid.uuid4().hex}"  # the driver's own folder, from which Spark serves files
    staged.mkdir()
    package = Path(__file__).resolve().parent
    with zipfile.ZipFile(staged / "tessella.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(staged / "tessella.zip"))
    _SHIPPED.add(context.applicationId)


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A folder of this machine stands in only on a local master, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        made = tempfile.mkdtemp(prefix="tessella-shared-")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL_DIRS[app] = f"file://{made}"
    return _LOCAL_DIRS[app]


#: What ``durable`` wrote and nothing removed yet: path -> its file system and Hadoop path.
_WRITTEN: dict[str, tuple[Any, Any]] = {}
#: Open scopes, the innermost last: the paths written in each.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _remove(path: str) -> None:
    held = _WRITTEN.pop(path, None)
    if held is not None:
        held[0].delete(held[1], True)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove at its end what ``durable`` wrote inside; a result that is to stay must have been stored elsewhere by then."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in mine:
            _remove(path)


@atexit.register
def remove_scratch() -> None:
    """Remove all that ``durable`` wrote in this application and that is still there."""
    for path in list(_WRITTEN):
        with suppress(Exception):  # the JVM may be gone
            _remove(path)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors or not.

    The table stays until ``discard``, the end of an enclosing ``scratch``, or the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/durable-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN[path] = target.getFileSystem(spark._jsc.hadoopConfiguration()), target
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._durable_path = path  # type: ignore[attr-defined]
    return back


def discard(*frames: DataFrame) -> None:
    """Remove what ``durable`` wrote, once nothing reads it any more."""
    for df in frames:
        _remove(getattr(df, "_durable_path", ""))


def keep(df: DataFrame) -> DataFrame:
    """Hand a durable table from the innermost scope to the one around it."""
    path, scopes = getattr(df, "_durable_path", None), _SCOPES.get()
    if scopes and path in scopes[-1]:
        scopes[-1].remove(path)
        if len(scopes) > 1:
            scopes[-2].append(path)
    return df
