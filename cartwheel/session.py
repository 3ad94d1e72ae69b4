"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes, coalesces
# small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", app: str = "cartwheel",
                  shuffle_partitions: int = 8, driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. Cluster jobs get their session
    from the launcher and only need ``DEFAULT_CONF``."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and model artefacts: the
    session's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a fresh scratch folder; a
    cluster job without it is refused rather than writing to a machine-local path.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this job")
        _local_dirs[app] = tempfile.mkdtemp(prefix="cartwheel-shared-")
    return _local_dirs[app]


_local_dirs: dict[str, str] = {}


#: Frees the shuffle files of a job when it ends: what is stored is not read from them again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str = "table", by: str | None = None):
    """``df`` written once as Parquet in the shared folder and read back: cuts its
    lineage with a file that every executor sees and that survives lost executors,
    and keeps column pruning and statistics for the steps that read it again. With ``by`` (its last
    column) there is a folder per value. The shuffle files of the job go when it ends."""
    spark = df.sparkSession
    path, writer = scratch_path(spark, name), df.write
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table) -> None:
    """Deletes a table of ``materialize`` that nothing reads any more."""
    spark = table.sparkSession
    for file in {name.rsplit("/cartwheel/", 1)[0] + "/cartwheel/" + name.rsplit("/cartwheel/", 1)[1].split("/", 1)[0]
                 for name in table.inputFiles() if "/cartwheel/" in name}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, never used before by any job."""
    return f"{checkpoint_dir(spark)}/cartwheel/{name}-{uuid.uuid4().hex}"
