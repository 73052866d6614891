"""Session helpers: shared scratch space, written intermediate tables, table loading.

Intermediate results are cut from their lineage by writing them as parquet below the shared folder named in
``spark.checkpoint.dir``. Such a table outlives the loss of any executor and takes less disk than a serialised
RDD checkpoint. Where the setting is absent, as in local tests, the session gets a temporary folder of its own; that
is refused for a master that is not local, as executors would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: str | None = None
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a temporary one when none is set."""
    global _local_scratch
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(f"file://{_local_scratch}")
    return f"file://{_local_scratch}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and stops recomputation. options: of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its scan has fewer parts than there are cores, as a small file of one row group has; a
    scan of many files is left alone, so that a large corpus is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Delete every table written by :func:`materialize` in this session. Only call it when no result is still needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for owner, path in [x for x in _written if x[0] is spark]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written.remove((owner, path))


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the JVM may be gone already
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
