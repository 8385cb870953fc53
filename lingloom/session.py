"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "lingloom", **conf: str) -> SparkSession:
    """A local session with the defaults the tests and the benchmark use."""
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    On a cluster it has to be configured; only a local master falls back to a
    temporary folder of the one machine there is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "lingloom-checkpoints")
    os.makedirs(folder, exist_ok=True)
    return folder


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_materialized() -> None:
    """Delete the tables written by ``materialize``; also runs when the driver ends."""
    _PATH_OF.clear()
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is gone, and with it the means to delete
            continue


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    A written table survives the loss of executors and is read column by column.
    Each call uses a fresh name; the files are removed when the driver ends, by
    ``remove_materialized``, or by ``forget`` once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lingloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[id(out)] = (out, path)
    return out


_PATH_OF: dict[int, tuple[DataFrame, str]] = {}  # the frame is held, so that its id is not given to another


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no plan to come reads; others are left alone."""
    for df in tables:
        _, path = _PATH_OF.pop(id(df), (None, None))
        if path is None:
            continue
        _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that are over deleted; Spark does so when the driver's JVM finds that no plan holds them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
