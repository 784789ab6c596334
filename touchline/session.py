"""Session helpers: settings the operators rely on, and the lineage cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime settings. AQE removes the skew branches of ``ordered`` when no key is hot and
# picks broadcast joins only after it has seen the size of a side.
# HotSpot does not compile methods above 8000 bytes; Spark should split such stages instead of fusing them
# (measured on the pricing queries: three times faster). Tails of up to 10,000 rows per key (G26) are cut before they
# are sorted.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("touchline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a session without one (tests) uses its warehouse, never a temp folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/touchline-checkpoints"


#: Spark removes a query's shuffle files when the query ends, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder so lost executors do not replay a long plan.

    ``free_shuffles``: the shuffles behind it go as soon as it is written, for plans that leave much on the disks.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    if not free_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        # a query takes the setting when it is made, and this one is read by nothing else
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that are not read any more. Their shuffles go when Spark collects them."""
    for df in frames:
        leaves = df._jdf.queryExecution().logical().collectLeaves()
        for i in range(leaves.size()):
            file = leaves.apply(i).rdd().getCheckpointFile() if leaves.apply(i).getClass().getSimpleName() == "LogicalRDD" else None
            if file is not None and file.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that go to a Python worker at once. Texts are a few KB, some far longer: Spark's 10,000 rows would be tens of MB
#: on both sides for each task.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch in this session; a smaller bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).removesuffix("b")) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))
