"""Reading named tables and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def is_local(master: str) -> bool:
    """Whether all executors run on the driver's machine."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may leave it unset; a temporary folder is then made and set.  On a
    cluster that is an error, as each machine would write to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="normloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_folders: set[tuple[str, str]] = set()


def _cut_folder(spark: SparkSession) -> str:
    """The application's own folder for cut tables; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/normloom-{app}"
    if (app, folder) not in _folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add((app, folder))
    return folder


def job_folder(spark: SparkSession) -> str:
    """A new folder for a job's files, removed with the cut tables."""
    return f"{_cut_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(df: DataFrame) -> str:
    path = f"{_cut_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows.

    What follows reads the table, so a lost executor costs only its own tasks
    and nothing before the cut runs twice.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


_kept: dict[tuple[str, str], tuple[str, StructType]] = {}


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several plans of the application read: made and written once under
    ``name``, which must say what it is made of; made again where the files are gone."""
    key = (spark.sparkContext.applicationId, name)
    if key in _kept:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_kept[key][0], "_SUCCESS")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            del _kept[key]
    if key not in _kept:
        df = make()
        _kept[key] = _written(df), df.schema
    return spark.read.schema(_kept[key][1]).parquet(_kept[key][0])


def parallel(df: DataFrame) -> DataFrame:
    """Rows of a few input splits spread over all cores, for steps that are long per row.

    Only where at most half of the cores would have work, as with one small file; larger
    inputs have splits enough and are left where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
