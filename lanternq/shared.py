"""Tables that cut lineage, kept in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or set with ``setCheckpointDir``. Only where both are unset and Spark runs on this machine alone (tests) a temporary one is set up; a cluster without one is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lanternq-')}")
        found = sc.getCheckpointDir()
    return found


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark drops an execution's shuffle files at its end if this is set; a parked table has no use for them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def parked(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of parked tables that nothing reads any longer."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
