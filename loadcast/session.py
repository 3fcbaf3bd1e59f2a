"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "loadcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC days; callers may override any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the JVM does not compile larger generated methods; Spark then splits the stage instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where that is unset, a folder in the warehouse.

    Both are shared by the driver and all executors, unlike a temporary folder. A warehouse on the machine's own disk is
    refused, unless all tasks run on this machine.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if urlsplit(warehouse).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} is unset and the warehouse {warehouse} is not shared with the executors")
    return f"{warehouse.rstrip('/')}/loadcast-shared"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """A result written as a Parquet table in the shared folder and read again, so its true size is known.

    With ``by`` it has one folder per value, so that a reader of one value opens only its own files.
    """
    path = f"{shared_folder(df.sparkSession)}/loadcast/settled-{uuid.uuid4().hex}"
    writer = df.repartition(by).write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small result once and keep it in the shared folder, cutting its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class TableStore:
    """Write-once tables of this application, kept as Parquet in the shared folder.

    The raw tables are reduced to day x region tables exactly once; everything after that reads
    the written result. A table is known only once its write has committed, so a lost executor or
    a failed job leaves nothing half-read, and Parquet gives the optimiser true sizes.
    """

    def __init__(self) -> None:
        self._paths: dict[tuple[str, str, str], str] = {}

    def table(self, spark: SparkSession, scope: str, name: str, build) -> DataFrame:
        key = (spark.sparkContext.applicationId, scope, name)
        if key not in self._paths:
            path = f"{shared_folder(spark)}/loadcast/{key[0]}/{name}-{uuid.uuid4().hex}"
            build().write.parquet(path)
            self._paths[key] = path
        return spark.read.parquet(self._paths[key])

    def folder(self, spark: SparkSession, scope: str, name: str) -> str:
        """A stable folder for things Spark writes itself, such as fitted models."""
        key = (spark.sparkContext.applicationId, scope, f"folder:{name}")
        if key not in self._paths:
            self._paths[key] = f"{shared_folder(spark)}/loadcast/{key[0]}/{name}-{uuid.uuid4().hex}"
        return self._paths[key]

    def forget(self) -> None:
        self._paths.clear()


STORE = TableStore()
