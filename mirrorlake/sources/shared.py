"""Tables in the folder that the cluster shares, to cut lineage where a job iterates."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mirrorlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mirrorlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_all(spark: SparkSession) -> None:
    """Remove all tables that were stashed under spark.checkpoint.dir. Call it when no result that reads them is
    needed any more: what operators return may be read lazily."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mirrorlake")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stash(df: DataFrame) -> None:
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
