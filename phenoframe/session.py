"""Session helpers shared by all operators: reading tables, cutting lineage, spreading work."""

from __future__ import annotations

import math
import os
import shutil
import sysconfig
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """See to it that Python workers can import this package: where they would not find it by themselves, it is sent as a zip, once a session."""
    root, sc = Path(__file__).resolve().parent.parent, spark.sparkContext
    seen = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd(), Path(sysconfig.get_path("purelib")).resolve()}
    if sc.master.startswith("local") and root in seen or getattr(sc, "_phenoframe_sent", False):
        return
    base = Path(tempfile.mkdtemp(prefix="phenoframe-"), "phenoframe_package")
    sc.addPyFile(shutil.make_archive(str(base), "zip", root, Path(__file__).resolve().parent.name))
    sc._phenoframe_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names in spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) is a temporary folder used; a cluster
    without the setting is an error, as a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="phenoframe-checkpoint-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _shuffled(df: DataFrame) -> bool:
    """Whether the plan holds a shuffle, by the kinds of its logical operators; unknown plans (another front end than the JVM's) count as shuffled."""
    try:
        todo = [df._jdf.queryExecution().optimizedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() in ("Aggregate", "Join", "Sort", "Distinct", "Window", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Except", "Intersect", "Deduplicate"):
                return True
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return False
    except AttributeError:
        return True


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Spread a few large input splits over the cores before CPU-heavy row-wise work.

    A scan that already has `per_core` splits a core is left as it is: at scale this adds no shuffle. So is what comes out of a
    shuffle, whose partitions cannot be counted without running it.
    """
    spark = df.sparkSession
    if _shuffled(df):
        return df
    want = max(shuffle_partitions(spark), per_core * spark.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than one row beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only where the side is proven small; beyond that Spark's own choice (AQE) holds."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def column_free(df: DataFrame, base: str) -> str:
    """A column name that does not clash with df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def ceil_share(share: float, n: int) -> int:
    return math.ceil(share * n - 1e-9)
