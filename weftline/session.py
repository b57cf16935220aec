"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it: Unicode spaces, no-break and zero-width ones included.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in this order. Names are taken exactly, so that an added column which differs
    in letter case only (`NAME` beside `name`) cannot make the reference ambiguous; the first of two equal names counts."""
    where: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        where.setdefault(c, i)
    missing = [n for n in names if n not in where]
    if missing:
        raise ValueError(f"no column {missing[0]}; there are {df.columns}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{where[n]}").alias(n) for n in names])


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir. Only where it names none and Spark runs on one machine
    (tests) a temporary folder is taken; on a cluster without the setting this is an error, since no executor could read
    what another one wrote."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not place and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Plans made once, for loops of many small steps that are run at once: a plan that is made again after each of its
    stages is a job a stage, and each of these plans stays in the driver's memory."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as there are cores. A table of a few small files is shuffled once (it is below
    a file split a core); a table with enough splits is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Tables written by cut_table in this process.
_TABLES: list[str] = []


def cut_table(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a compressed table written in the shared checkpoint folder: for wide rows, which a
    checkpoint would store uncompressed, and for rows that several later steps read. clear_tables deletes them."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> int:
    """Deletes the tables that cut_table wrote in this process, when their results are no longer needed; their number."""
    jvm, n = spark.sparkContext._jvm, 0
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
