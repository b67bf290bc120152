"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, str] = {}


#: Tables whose files are larger are not broadcast by their file size: columns of repeated keys
#: are tens of times larger in memory, and a broadcast passes through the driver.
FILE_BROADCAST = "64KB"
#: The same between stages, where Spark has measured the rows: a loop's rounds send a bounded part of a table.
ROW_BROADCAST = "1MB"
#: The JVM never compiles longer methods: larger fused stages would run interpreted, while their
#: expressions one by one stay below it.
METHOD_BYTES = "8000"
#: Shuffle files go when the execution that wrote them ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession, file_broadcast: str = FILE_BROADCAST, row_broadcast: str = ROW_BROADCAST, method_bytes: str = METHOD_BYTES) -> SparkSession:
    """Apply the runtime settings the operators assume."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", file_broadcast)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", row_broadcast)
    # Geometry and text work is heavy per byte: let small shuffles keep all cores busy.
    # Large shuffles are not affected, their target size stays the advisory one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", method_bytes)
    return spark


def local_session(cores: str = "8", partitions: int = 8, app: str = "emberlake") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own:
    a machine-local path would be lost together with the executor on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it back.

    The copy outlives executors, is columnar (later reads prune columns) and
    gives the next plan real file sizes to choose join strategies from.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/emberlake/{label}-{uuid.uuid4().hex}"
    # Nothing reads the shuffles behind the copy again; without this they stay until the driver collects garbage.
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(cut: DataFrame) -> None:
    """Delete the copy behind a cut whose result nothing will read again, such as the last round of a loop."""
    path = cut.sparkSession._jvm.org.apache.hadoop.fs.Path(cut.cut_path)
    path.getFileSystem(cut.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
