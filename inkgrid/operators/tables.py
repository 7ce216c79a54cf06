"""Tables written once and read back, in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own if driver and executors are one process. On a
    cluster it must be set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inkgrid-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, from a table in the shared folder: lineage ends there and executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/inkgrid-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task of a shuffle by key should hold, and as many tasks as are always few enough to be left as they are.
TASK_ROWS, FEW = 250_000, 16


def spread(df: DataFrame, *key: str, rows: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """The same rows; a large table is dealt by ``key`` over tasks of about ``rows`` rows (``TASK_ROWS``). A shuffle that is left to itself is sized by its compressed
    bytes, of which narrow rows have so few that millions of them, and all that is made of them, meet in one task. Counts the rows of ``df``, or
    of the table ``of`` that it is made from: one just read tells its own number."""
    parts = -(-(of or df).count() // (rows or TASK_ROWS))
    return df.repartition(parts, *key) if parts > FEW else df


def discarded(df: DataFrame) -> None:
    """Deletes the table of ``written`` that ``df`` reads, when nothing will read it any more. No other table is touched."""
    sc = df.sparkSession.sparkContext
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if re.fullmatch(r".*/inkgrid-tables/[0-9a-f]{32}", path):
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
