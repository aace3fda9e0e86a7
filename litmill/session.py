"""Session defaults and the durable cut of a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that only set a default; a cluster's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "litmill", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a local master (tests on one machine) a temporary folder is made, used from then on and
    removed at exit; on a cluster, whose executors could not read it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="litmill-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


_own: str | None = None


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs the reading of files and not the work before them. The files are
    columnar and compressed, so the cut takes less disk than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote since the last call, once the results made of them are written; their number.

    Results not yet written can't be read afterwards.
    """
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = len(_tables)
    while _tables:
        where = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        where.getFileSystem(configuration).delete(where, True)
    return done


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application; without effect where they have it already."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="litmill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/litmill_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
