"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that operators rely on. They can be changed on a running session, so queries may set them themselves.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local use and tests; on a cluster the submitted session is used as it is."""
    builder = SparkSession.builder.master(master).appName("strataforge")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**settings, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings of ``RUNTIME_CONF`` on a session that someone else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of files that has fewer partitions than there are cores, dealt out to all cores; any other scan unchanged.

    For work that costs far more than its bytes (parsers, tokenizers) on small files. On large tables, whose scans have many
    partitions, it does nothing. Only for plans without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Partitioned by columns into as many partitions as the session shuffles into, and at least one a core.

    For costly work after a grouping on the same columns: the grouping needs no further exchange, and partitions are not coalesced by their few bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


_OWN_DIR: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, a laptop) a temporary folder of this machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="strataforge-"))
    return f"file://{_OWN_DIR[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts lineage so that a lost executor costs no recomputation, and lets several
    consumers read one result. The tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataforge/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            pass
