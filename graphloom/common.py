"""Session-level helpers: shared scratch tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space at either end of a string (Java regex; ``(?U)`` makes ``\s`` Unicode-aware).
EDGE_SPACE = r"(?U)^\s+|\s+$"

#: Largest side that the library itself broadcasts, in bytes of its written Parquet files.
BROADCAST_BYTES = 16 << 20

_local_dirs: dict[str, str] = {}


def strip_name(col: Column | str) -> Column:
    """The name without surrounding white space; null for null and blank names."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.regexp_replace(c, EDGE_SPACE, "")
    return F.when(s != "", s)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local temporary folder is used if the master is local, else
    an error is raised, since a machine-local folder would not survive the loss of an executor.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="graphloom-"))
    return f"{base.rstrip('/')}/graphloom-{app}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, computes the plan once, survives lost executors, and gives the optimiser
    real file sizes, so that later joins broadcast only what has been measured.
    """
    return cut_counted(df, label)[0]


def cut_counted(df: DataFrame, label: str = "cut") -> tuple[DataFrame, int]:
    """``cut`` with the number of rows, observed while writing."""
    out, seen = cut_observed(df, label, n=F.count(F.lit(1)))
    return out, int(seen["n"])


def cut_observed(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` with aggregates of the rows, observed while writing."""
    spark, path, seen = df.sparkSession, scratch_path(df.sparkSession, label), Observation()
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out, seen.get


def stack(cuts: list[DataFrame]) -> DataFrame:
    """The union of tables made by ``cut`` with one schema, as one scan."""
    spark = cuts[0].sparkSession
    return spark.read.schema(cuts[0].schema).parquet(*[c._cut_path for c in cuts])


def drop_cut(*dfs: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in dfs:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def purge(spark: SparkSession) -> None:
    """Delete all scratch tables of this application."""
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table made by ``cut``."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the table, as ``cut`` made it, is below ``limit`` bytes; else the table as it is,
    which the optimiser then joins by shuffle, with AQE splitting skewed partitions."""
    return F.broadcast(df) if written_bytes(df) <= limit else df


def broadcast_blocks(df: DataFrame, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """A query set, as ``cut`` made it, in blocks of about ``limit`` bytes at most, by a hash of its rows; each can be
    sent to all tasks, so the set may be of any size and nothing switches to another join."""
    n = max(1, -(-written_bytes(df) // limit))
    return [df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
