"""Exact duplicates by two-pass Bloom filtering.

Pass one marks in a blocked Bloom filter which positions were hit once and
which twice. The pair (once, twice) merges associatively: a position that two
tasks hit once each counts as hit twice. A text that occurs twice anywhere has
all its positions hit twice. Pass two tests each hash against the ``twice``
bits: hashes that fail are certainly unique and pass straight through; only
the others shuffle, as digests, where the exact digest decides. Whole rows
shuffle only where a second filter, of the digests that do repeat, lets them:
unique texts stay where they are even when the first filter is crowded.

A filter takes ``bits_per_row`` bits a row up to ``max_blocks`` blocks of 8 KB,
so what is broadcast is at most ``max_blocks`` * 8 KB (64 MB by default, which
serves about 100 million rows; a cluster with larger executors passes more).
Beyond that size more digests of unique rows are let into the shuffle, 60 bytes
each; results stay exact.

Defined results: a null text equals the empty text; null ids sort last; of
rows that tie in everything one is kept; very long texts count whole; an empty
table gives an empty table; columns of the input keep their values whatever
they are called, because rows are carried as one struct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tripweave.llm.common import Scratch, cut, row_hash, strip_spaces

BLOCK_BITS = 65536
FLUSH = 2_000_000


def normalised(text: Column) -> Column:
    return strip_spaces(F.coalesce(text, F.lit("")))


def _positions(h: np.ndarray, n_blocks: int) -> np.ndarray:
    """Two positions in one block for each 64-bit hash."""
    h = h.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(16)) & np.uint64(n_blocks - 1)) << np.uint64(16)
    return np.concatenate([block | (h & np.uint64(0xFFFF)), block | ((h >> np.uint64(44)) & np.uint64(0xFFFF))]).astype(np.int64)


def _marks(positions: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (block, once, twice): sorted 16-bit offsets as bytes."""
    at, n = np.unique(np.concatenate(positions), return_counts=True)
    block, offset = at >> 16, (at & 0xFFFF).astype(np.uint16)
    blocks, starts = np.unique(block, return_index=True)
    ends = np.append(starts[1:], len(at))
    once = [offset[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    twice = [offset[a:b][n[a:b] >= 2].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])


def repeated_filter(hashes: DataFrame, col: str, rows: int, bits_per_row: int = 16, max_blocks: int = 8192) -> tuple[np.ndarray, int]:
    """Bits (one row of 8 KB for each block) of the positions hit at least twice."""
    n_blocks = _size(rows, bits_per_row, max_blocks)

    def mark(batches):
        held, n = [], 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            held.append(_positions(h, n_blocks))
            n += len(h)
            if n >= FLUSH:
                yield _marks(held)
                held, n = [], 0
        if n:
            yield _marks(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(rows["once"]), np.uint16)
        twice = np.frombuffer(b"".join(rows["twice"]), np.uint16)
        hits = np.bincount(once, minlength=BLOCK_BITS) >= 2
        hits[twice] = True
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "bits": [np.packbits(hits, bitorder="little").tobytes()]})

    marks = hashes.select(col).mapInArrow(mark, "block int, once binary, twice binary")
    return _table(marks.groupBy("block").applyInPandas(merge, "block int, bits binary"), n_blocks), n_blocks


def _table(blocks: DataFrame, n_blocks: int) -> np.ndarray:
    bits = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
    for row in blocks.collect():  # at most max_blocks rows of 8 KB
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _probe(bits: np.ndarray, spark: SparkSession):
    """A function of 64-bit hashes: whether both positions are set."""
    shared, n_blocks = spark.sparkContext.broadcast(bits), len(bits)

    def probe(h: pd.Series) -> pd.Series:
        flat, at = shared.value.reshape(-1), _positions(h.to_numpy(), n_blocks)
        hit = (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return pd.Series((hit[: len(h)] & hit[len(h) :]).astype(bool))

    probe.__annotations__ = {"h": pd.Series, "return": pd.Series}
    return F.pandas_udf(probe, BooleanType())


def _size(rows: int, bits_per_row: int, max_blocks: int) -> int:
    n_blocks = 1
    while n_blocks < max_blocks and n_blocks * BLOCK_BITS < rows * bits_per_row:
        n_blocks *= 2
    return n_blocks


def maybe_repeated(hashes: DataFrame, col: str, rows: int, **size) -> Column:
    """A boolean column over ``col``: false means that the hash is certainly unique."""
    bits, _ = repeated_filter(hashes, col, rows, **size)
    return _probe(bits, hashes.sparkSession)(F.col(col))


def maybe_in(wanted: DataFrame, col: str, bits_per_row: int = 16, max_blocks: int = 8192) -> Column:
    """A column over ``col``: false where it is certainly not in ``wanted`` (a Bloom filter of at most 64 MB)."""
    n_blocks = _size(wanted.count(), bits_per_row, max_blocks)

    def mark(batches):
        for batch in batches:
            at = np.unique(_positions(batch.column(0).to_numpy(), n_blocks))
            block = at >> 16
            for k in np.unique(block):
                bits = np.zeros(BLOCK_BITS, bool)
                bits[at[block == k] & 0xFFFF] = True
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(k)], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "bits": [bits.tobytes()]})

    marks = wanted.select(F.xxhash64(col).alias("h")).mapInArrow(mark, "block int, bits binary")
    bits = _table(marks.groupBy("block").applyInPandas(merge, "block int, bits binary"), n_blocks)
    return _probe(bits, wanted.sparkSession)(F.xxhash64(F.col(col)))


def label_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **size) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points, then the smallest id stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("_id"), F.length(text).alias("_len"), F.sha2(normalised(F.col(text_col)), 256).alias("_sha"))
    slim = cut(slim.withColumns({"_h": F.xxhash64("_sha"), "_row": F.monotonically_increasing_id()}))
    marked = slim.withColumn("_maybe", maybe_repeated(slim, "_h", slim.count(), **size))
    rank = F.struct(-F.col("_len"), F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    groups = marked.filter("_maybe").groupBy("_sha").agg(F.min_by(F.struct("_id", "_row"), rank).alias("_keep"), F.count("*").alias("_n"))
    # Written first, so that both sides of the join are shuffled and AQE can split a hot group.
    repeated = marked.filter("_maybe").join(cut(groups), "_sha").select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    single = marked.filter(~F.col("_maybe")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    return single.unionByName(repeated)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **size) -> DataFrame:
    """The rows that stay, with all their columns; of unique texts nothing but digests may shuffle."""
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    tables = Scratch(df.sparkSession)
    try:
        hashes = tables.keep(df.select(sha.alias("sha"), F.xxhash64(sha).alias("h")))
        repeats = hashes.filter(maybe_repeated(hashes, "h", hashes.count(), **size)).groupBy("sha").agg(F.count("*").alias("n"))
        again = maybe_in(tables.keep(repeats.filter("n > 1").select("sha")), "sha", **size)
    finally:
        tables.close()
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), sha.alias("sha")).withColumn("again", again)
    text, own = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), F.col(f"row.`{id_col}`")
    rank = F.struct(-F.length(text), own.isNull(), own, row_hash(df, "row"))
    best = keyed.filter("again").groupBy("sha").agg(F.min_by("row", rank).alias("row"))
    return keyed.filter(~F.col("again")).select("row").union(best.select("row")).select("row.*")
