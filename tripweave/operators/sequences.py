"""Ordered-row operators: runs, feasible times, schedules, list edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, HERE, END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def by(part: str | list[str], order: str | list[str]):
    return Window.partitionBy(part).orderBy(order)


def uniq_by(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """First row of each key."""
    return df.withColumn("_rn", F.row_number().over(by(keys, ties))).filter("_rn = 1").drop("_rn")


def numbered(df: DataFrame, part: str, order: str) -> DataFrame:
    """Adds ``pos`` (from 1) and ``n`` within ``part``."""
    return df.withColumn("pos", F.row_number().over(by(part, order))).withColumn("n", F.count("*").over(Window.partitionBy(part)).cast("int"))


def runs(df: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """Adds ``run``: the number of the stretch of equal ``key`` in a row (nulls equal)."""
    w = by(part, order)
    before = F.lag(key).over(w)
    change = F.when(F.row_number().over(w) == 1, 0).when(before.eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(START, HERE))).drop("_change")


def dedup_successive(df: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """Drops rows whose key equals that of the row before."""
    w = by(part, order)
    marked = df.withColumn("_same", F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1))
    return marked.filter("NOT _same").drop("_same")


def neighbours(df: DataFrame, part: str, order: str, key: str) -> DataFrame:
    """Adds ``prev_`` and ``next_`` of ``key``, null at the ends."""
    w = by(part, order)
    return df.withColumns({f"prev_{key}": F.lag(key).over(w), f"next_{key}": F.lead(key).over(w)})


def with_travel(df: DataFrame, travel: DataFrame | Callable, a: str, b: str, out: str) -> DataFrame:
    """Left join of the travel time from column ``a`` to column ``b``; 0 if either is null.

    ``travel`` is a matrix (src, dst, ms), or a function (df, a, b, out) that adds the times itself.
    """
    if not isinstance(travel, DataFrame):
        return travel(df, a, b, out)
    legs = travel.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("ms").alias(out))
    return df.join(legs, [a, b], "left").withColumn(out, F.coalesce(out, F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0))))


def with_travels(df: DataFrame, travel: DataFrame | Callable, legs: list[tuple[str, str, str]]) -> DataFrame:
    """``with_travel`` for several legs (a, b, out), at once where ``travel`` can."""
    if hasattr(travel, "many"):
        return travel.many(df, legs)
    for a, b, out in legs:
        df = with_travel(df, travel, a, b, out)
    return df


def step_time(prev: Column, stop: Column, travel: Column, dwell: int, service: Column | int = 0) -> Column:
    """Time from one activity to the next: dwell unless at the same place, service, travel."""
    return F.when(prev.eqNullSafe(stop), 0).otherwise(dwell) + service + travel


def feasible_times(df: DataFrame, part: str, order: str, step: str, low: str = "min_t", high: str = "max_t") -> DataFrame:
    """Adds ``earliest`` and ``latest``; ``step`` is the time from the row before (null at the first).

    Closed forms of the recurrences: with C the running sum of steps,
    earliest = C + running max of (low - C), latest = C + suffix min of (high - C).
    """
    w = by(part, order)
    df = df.withColumn("_c", F.sum(F.coalesce(step, F.lit(0))).over(w.rowsBetween(START, HERE)))
    return df.withColumns(
        {"earliest": F.col("_c") + F.max(F.col(low) - F.col("_c")).over(w.rowsBetween(START, HERE)), "latest": F.col("_c") + F.min(F.col(high) - F.col("_c")).over(w.rowsBetween(HERE, END))}
    ).drop("_c")


def feasible(df: DataFrame, part: str) -> DataFrame:
    """Per route: whether every earliest time is within the latest; errors as values."""
    ok = F.bool_and(F.col("earliest") <= F.col("latest"))
    return df.groupBy(part).agg(F.when(ok, "ok").otherwise("infeasible").alias("status"))


def time_to_end(df: DataFrame, part: str, order: str, leg: str) -> DataFrame:
    """Adds ``to_end``: the sum of the legs from each row to the last."""
    return df.withColumn("to_end", F.coalesce(F.sum(leg).over(by(part, order).rowsBetween(HERE, END)), F.lit(0)))


def optimistic_schedule(df: DataFrame, part: str, order: str, planned: str, is_pickup: str, dwell: int = 60_000, optimism: int = 180_000) -> DataFrame:
    """Adds ``scheduled``: pickups run up to ``optimism`` early but ``dwell`` apart, dropoffs as planned.

    s0 = p0, si = max(s(i-1) + dwell, pi - optimism) for pickups: a running maximum of
    (pj - optimism - dwell * j), whose first term is p0.
    """
    w = by(part, order)
    df = df.withColumn("_j", F.row_number().over(w) - 1)
    term = F.when(F.col("_j") == 0, F.col(planned)).otherwise(F.col(planned) - optimism - dwell * F.col("_j"))
    best = F.max(F.when(F.col(is_pickup), term)).over(w.rowsBetween(START, HERE)) + dwell * F.col("_j")
    return df.withColumn("scheduled", F.when(F.col(is_pickup), best).otherwise(F.col(planned))).drop("_j")


def backward_times(df: DataFrame, part: str, order: str, leg: str, end: str, dwell: int = 60_000) -> DataFrame:
    """Adds ``arrive``: chained from the last row's ``end`` backwards by leg and dwell; ``leg`` leads to the next row."""
    w = by(part, order)
    last = F.last(end).over(w.rowsBetween(HERE, END))
    df = df.withColumn("_step", F.when(F.lead(F.lit(1)).over(w).isNotNull(), F.col(leg) + dwell).otherwise(0))
    return df.withColumn("arrive", last - F.sum("_step").over(w.rowsBetween(HERE, END))).drop("_step")


def suffix_best(df: DataFrame, part: str, order: str, cost: str) -> DataFrame:
    """Adds ``best_cost`` and ``best_at`` among this and later rows; ties go to the later row."""
    w = by(part, order).rowsBetween(HERE, END)
    best = F.min(F.struct(F.col(cost), (-F.col(order)).alias("back"))).over(w)
    return df.withColumns({"best_cost": best[cost], "best_at": -best["back"]})


def gap_to_previous(df: DataFrame, part: str, at: str) -> DataFrame:
    """Adds ``gap``: time since the part's row before."""
    return df.withColumn("gap", F.col(at) - F.lag(at).over(by(part, at)))


# ------------------------------------------------------------- ordered lists


def place_of(items: Column, gap: Column) -> Column:
    """Index (from 1) of the first item of a gap (two neighbours in a list); 0 if absent."""
    n = F.size(items)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(at, lambda i: (F.element_at(items, i) == gap[0]) & (F.element_at(items, i + 1) == gap[1]))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(0))


def insert_two(items: Column, a: Column, b: Column, gap1: Column, gap2: Column) -> Column:
    """The list with ``a`` in gap1 and ``b`` in gap2 (both in order if the gaps are one); null if a gap is absent or gap2 comes before gap1."""
    i, j = place_of(items, gap1), place_of(items, gap2)
    n = F.size(items)
    out = F.concat(F.slice(items, F.lit(1), i), F.array(a), F.slice(items, i + 1, j - i), F.array(b), F.slice(items, j + 1, n - j))
    return F.when((i > 0) & (j >= i), out)


def inserted_window(items: Column, a: Column, b: Column, gap1: Column, gap2: Column) -> Column:
    """From the item before ``a`` to the item behind ``b`` of the same list."""
    i, j = place_of(items, gap1), place_of(items, gap2)
    return F.when((i > 0) & (j >= i), F.slice(insert_two(items, a, b, gap1, gap2), i, j - i + 4))
