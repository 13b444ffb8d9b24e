"""Tables written between the steps of a job, so that lineage ends there and lost executors cost no recomputation."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local runs and an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spendlake-')}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
