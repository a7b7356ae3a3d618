"""Sessions, and the package's way to the workers."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(name: str = "fringeframe", master: str | None = None, **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything in ``options`` (dots as double underscores) is set on top."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per context, for those that don't have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_fringeframe_shipped", False):
        return
    with tempfile.NamedTemporaryFile(prefix="fringeframe-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, f"{PACKAGE.name}/{path.relative_to(PACKAGE)}")
    atexit.register(Path(f.name).unlink, missing_ok=True)  # executors fetch it from the driver while the context lives
    context.addPyFile(f.name)
    context._fringeframe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches; checkpoints go there too.

    Where it is unset, as in tests, a local master gets a new temporary one; a cluster is refused, since its executors
    don't share the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
