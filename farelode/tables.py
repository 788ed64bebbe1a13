"""Reading of the parquet tables and small helpers shared by all operators."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once; they need not have it on their path.

    The archive lies in the shared folder, from where Spark hands it to every executor, also to those that start later.
    """
    context = spark.sparkContext
    if getattr(context, "_farelode_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"farelode/{p.relative_to(package)}"), p.read_bytes())
    content = packed.getvalue()
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, f"code/{hashlib.sha256(content).hexdigest()[:16]}/farelode.zip"))
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        out.write(bytearray(content))
        out.close()
    context.addPyFile(files.makeQualified(path).toString())
    context._farelode_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer: for much work on rows of a small file.

    Larger inputs come in more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def clean_id(column: Column) -> Column:
    """An id without surrounding white space (of any script) and case; null where nothing is left."""
    bare = F.regexp_replace(column, r"^[\s\p{Z}\x{FEFF}\x{200B}]+|(?<![\s\p{Z}\x{FEFF}\x{200B}])[\s\p{Z}\x{FEFF}\x{200B}]+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder for tables that a job writes and reads again; it lies where all executors reach it.

    That is in the cluster's ``spark.checkpoint.dir``. Where that is unset, a local session uses its warehouse, as in tests; a
    session with executors of its own is refused, as a folder of one machine would not reach them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = chosen.get() if chosen.isDefined() else None  # set by the caller
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{base}/{name}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which keeps the partitions and the order in them.

    The files lie in the shared folder and survive the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark, "").rstrip("/"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a written table: smaller than a checkpoint and read by column, but in other partitions.

    It lies in the shared folder and is removed when the application ends.
    """
    spark = df.sparkSession
    name = shared_folder(spark, f"tables/{uuid.uuid4().hex}")
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(name)
    return spark.read.schema(df.schema).parquet(name)
