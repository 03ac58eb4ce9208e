"""What several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the contracts, as it stands inside a regex class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tripweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there; survives lost executors."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (pafs.LocalFileSystem(), path)


class Scratch:
    """Written tables of one run in the shared folder: they cut lineage, survive lost executors, and go when ``close`` is called."""

    def __init__(self, spark: SparkSession):
        self.path, self.n = f"{ensure_shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        where = f"{self.path}/{self.n}"
        df.write.parquet(where)
        return df.sparkSession.read.schema(df.schema).parquet(where)

    def close(self) -> None:
        """Delete all tables; what is still lazy must not refer to them. Where only Spark knows the file system they stay."""
        try:
            system, path = file_system(self.path)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as unknown:
            warnings.warn(f"{self.path} is left behind: {unknown}", stacklevel=2)
            return
        if system.get_file_info(path).type != pafs.FileType.NotFound:
            system.delete_dir(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only when the counted ``rows`` are within ``limit``; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def row_hash(df: DataFrame, row: str) -> Column:
    """A hash of the columns of ``df`` that are held in the struct ``row``; columns with maps have none and take no part."""
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*[F.col(f"{row}.`{c}`") for c in hashed])


def strip_spaces(text: Column) -> Column:
    """Delete every character of the contracts' white space."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), SPACES, text)


def word_count(text: Column) -> Column:
    """Number of words (null: 0) as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sum(df: DataFrame, part: list[str], order: str, value: str, out: str, fan: int = 1024, kind: str = "long") -> DataFrame:
    """Exclusive running sum of ``value`` within ``part`` by the integer ``order``.

    Two levels, so that no window group holds more than ``fan`` rows of the
    lower level: chunks of ``fan`` are summed first, and the sums prefixed.
    ``df`` must hold one row per (part, order).
    """
    low = df.withColumn("_chunk", F.floor(F.col(order) / fan))
    chunks = low.groupBy(*part, "_chunk").agg(F.sum(value).alias("_sum"))
    over_chunks = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*part, "_chunk", F.coalesce(F.sum("_sum").over(over_chunks), F.lit(0)).alias("_chunk_base"))
    inside = Window.partitionBy(*part, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        low.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(chunks, [*part, "_chunk"])
        .withColumn(out, (F.col("_chunk_base") + F.col("_run")).cast(kind))
        .drop("_chunk", "_chunk_base", "_run")
    )


def ranked(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """``df`` with its place 1, 2, .. in the order of the given columns, without a window over all rows.

    Range partitions are sorted on their own and numbered; the counts of the partitions give each its base.
    The order must be total for reruns to agree.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    base = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_k")).select("_part", base.alias("_base"))  # a row for each partition
    return rows.join(F.broadcast(counts), "_part").withColumn(out, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")
