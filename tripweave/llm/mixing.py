"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end as a stream
of words, cut into blocks of ``block`` words. Slot n of the mix takes the point
frac(n * golden ratio), which the cumulative targets map to a source; the k-th
slot of a source takes the k-th block of its stream, and the stream starts over
when it ends. A source whose last few slots the sequence has not yet dealt gets
them at the end, so each source yields its rounded target exactly. The schedule
decides the order: ``taken_words`` tells each document's first slot, and
``mixed_documents`` returns the mix in the order of the slots.

Only DataFrame functions run here. Positions in a stream, ranks of slots and
the order of the sources are prefix sums over pieces of bounded size, so a hot
source is spread over many tasks, and no window holds all rows or all sources.
Rows that tie in id and size are spread by their number where they are many.
Reruns agree: all orders follow from hashes of ids and, for ties, row numbers.

Defined results: a null text has no words; a null source is a source of its
own and comes last; documents without words take no part in the schedule; null
and repeated ids are shuffled like others, each row on its own; very long texts
fill as many blocks as they need; an empty table gives an empty mix; columns of
the input keep their values whatever they are called, because rows are carried
as one struct.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import broadcast_if_small, cut, prefix_sum, ranked, word_count

#: Fractional part of the golden ratio.
GOLDEN = "0.618033988749894848"
BUCKET_ROWS = 1024
SLOT_CHUNK = 1024
SMALL_SOURCES = 20_000


class Mix(NamedTuple):
    rows: DataFrame  # _row, _src, id, source, size, source_size, target, _start
    spans: DataFrame  # slot, place, _row, epoch, from_word, words


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: its order, size, rows and target.

    ``share`` times all words are split by weight; what exceeds ``cap`` times a
    source's size goes to the others by weight. The fixed point is one level L
    with target = least(cap * size, L * weight), found in the order of the
    sources' cap * size / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    per = ranked(per, "_src", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_src") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumns({"_w": weight, "_top": cap * F.col("source_size")}).withColumn("_ratio", F.col("_top") / F.col("_w"))
    per = cut(ranked(per, "_place", F.col("_ratio"), F.col("_src")))
    words, heft = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    sums = prefix_sum(prefix_sum(per, [], "_place", "_top", "_spent", kind="double"), [], "_place", "_w", "_before", kind="double")
    level = (F.lit(share * words) - F.col("_spent")) / (F.lit(heft) - F.col("_before"))
    first = sums.withColumn("_level", level).filter("_level <= _ratio").agg(F.min_by("_level", "_place")).first()[0]
    target = F.col("_top") if first is None else F.least("_top", F.lit(first) * F.col("_w"))
    return per.select("source", "_src", "source_size", "_n", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 1024, **target) -> Mix:
    """The rows with their place in the streams, and the spans that the slots take; spans refer to rows by a fresh number."""
    size = word_count(F.col(text_col))
    return mix_sized(df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), block, **target)


def mix_sized(slim: DataFrame, block: int = 1024, **target) -> Mix:
    """``mix`` of rows (_row, id, source, size)."""
    slim = cut(slim)
    per = cut(source_targets(slim, **target).withColumns({"_take": F.round("target").cast("long")}).withColumn("_slots", F.ceil(F.col("_take") / block)))
    n_sources, n_slots = per.agg(F.count("*"), F.coalesce(F.sum("_slots"), F.lit(0))).first()

    small = broadcast_if_small(per, n_sources, SMALL_SOURCES)
    rows = slim.join(small, slim["source"].eqNullSafe(per["source"])).drop(per["source"])
    rows = rows.withColumn("_h", F.xxhash64("id", "size")).withColumn("_bucket", F.pmod("_h", F.ceil(F.col("_n") / BUCKET_ROWS)))
    rows = spread_ties(rows)
    buckets = prefix_sum(rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_words")), ["_src"], "_bucket", "_words", "_base")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_h", "id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets.select("_src", "_bucket", "_base"), ["_src", "_bucket"])
        .withColumn("_start", F.col("_base") + F.col("_run"))
    )
    rows = cut(rows.select("_row", "_src", "id", "source", "size", "source_size", "target", "_take", "_start"))

    slots = schedule(per, n_sources, n_slots)
    pieces = rows.filter("size > 0 AND _take > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_take") - 1) / F.col("source_size")))))
    pieces = pieces.withColumn("_lo", F.col("_start") + F.col("epoch") * F.col("source_size"))
    pieces = pieces.withColumn("_hi", F.least(F.col("_lo") + F.col("size"), "_take")).filter("_lo < _hi")
    pieces = pieces.withColumn("_rank", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    first = F.greatest(F.col("_lo"), F.col("_rank") * block)
    pieces = pieces.select("_src", "_rank", "_row", "epoch", first.alias("place"), (first - F.col("_lo")).alias("from_word"), (F.least(F.col("_hi"), (F.col("_rank") + 1) * block) - first).alias("words"))
    spans = pieces.join(slots, ["_src", "_rank"]).select("slot", "place", "_row", "epoch", "from_word", "words")
    return Mix(rows, spans)


def spread_ties(rows: DataFrame) -> DataFrame:
    """Buckets that hold far more rows than meant, because rows tie in id and size, are dealt into several by row number."""
    crowded = rows.groupBy("_src", "_bucket").agg(F.count("*").alias("_k")).filter(F.col("_k") > 8 * BUCKET_ROWS)
    crowded = cut(crowded.withColumn("_parts", F.ceil(F.col("_k") / BUCKET_ROWS)).drop("_k"))
    n, most = crowded.agg(F.count("*"), F.max("_parts")).first()
    if not n:
        return rows
    rows = rows.join(broadcast_if_small(crowded, n, SMALL_SOURCES), ["_src", "_bucket"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0))
    return rows.withColumn("_bucket", F.col("_bucket") * most + part).drop("_parts")


def schedule(per: DataFrame, n_sources: int, n_slots: int) -> DataFrame:
    """Rows (slot, _src, _rank): which source each slot takes and its rank there."""
    spark = per.sparkSession
    grid = max(4 * n_sources, 1)
    part = lambda n: n / F.lit(float(max(n_slots, 1)))
    bounds = prefix_sum(per.select("_src", "_slots"), [], "_src", "_slots", "_before").filter("_slots > 0")
    bounds = bounds.withColumns({"_from": part(F.col("_before")), "_to": part(F.col("_before") + F.col("_slots"))})
    bounds = bounds.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * grid), F.floor(F.col("_to") * grid))))
    bounds = bounds.select("_src", "_slots", "_from", "_to", "_cell")
    point = ((F.col("slot").cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(18,18)")) % F.lit(1).cast("decimal(1,0)")).cast("double")
    dealt = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("_x", point).withColumn("_cell", F.floor(F.col("_x") * grid))
    # Each point lies in one interval; _to of one source is _from of the next, the last is 1.
    dealt = dealt.join(broadcast_if_small(bounds, 6 * n_sources, SMALL_SOURCES), "_cell").filter("_x >= _from AND _x < _to")
    dealt = dealt.select("slot", "_src", "_slots", F.floor(F.col("slot") / SLOT_CHUNK).alias("_part"))
    counts = prefix_sum(dealt.groupBy("_src", "_part").agg(F.count("*").alias("_k")), ["_src"], "_part", "_k", "_base")
    inside = Window.partitionBy("_src", "_part").orderBy("slot")
    placed = dealt.withColumn("_at", F.row_number().over(inside) - 1).join(counts.select("_src", "_part", "_base"), ["_src", "_part"])
    placed = placed.select("slot", "_src", "_slots", (F.col("_base") + F.col("_at")).alias("_rank")).filter("_rank < _slots")
    got = counts.groupBy("_src").agg(F.sum("_k").alias("_got"))
    late = per.select("_src", "_slots").join(got, "_src", "left").withColumn("_got", F.coalesce("_got", F.lit(0).cast("long"))).filter("_got < _slots")
    late = late.withColumn("_rank", F.explode(F.sequence("_got", F.col("_slots") - 1)))
    late = late.select((F.lit(n_slots) + (F.col("_rank") - F.col("_got")) * n_sources + F.col("_src") - 1).alias("slot"), "_src", "_slots", "_rank")
    return placed.unionByName(late).drop("_slots")


def taken_words(mixed: Mix) -> DataFrame:
    """Per row of the input: what the mix takes of it, repeats counted, its first slot and the number of its pieces."""
    taken = mixed.spans.groupBy("_row").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("pieces"))
    out = mixed.rows.join(taken, "_row", "left")
    none = F.lit(0).cast("long")
    return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("pieces", none).alias("pieces"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix as whole documents in the order of the slots, with the columns of ``df``: one row each
    time that a slot takes a document's first word. ``df`` must be a stored table, whose rows are
    numbered alike each time it is read.
    """
    own = lambda c: F.col(f"row.`{c}`")
    numbered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("_row"))
    mixed = mix_sized(numbered.select("_row", own(id_col).alias("id"), own(source_col).alias("source"), word_count(own(text_col)).alias("size")), **how)
    starts = mixed.spans.filter("from_word = 0").select("_row", "slot", "place")
    return numbered.join(starts, "_row").orderBy("slot", "place", "_row").select("row.*")
