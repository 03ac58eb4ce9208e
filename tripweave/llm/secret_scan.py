"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Beside them, runs of 16 or more
credential characters are candidates for a likelihood-ratio test between two
character Markov models: one of random strings, one of ordinary identifiers.
Both are bigram tables over 54 symbols (letters by case, digits as one, marks
as one), smoothed by one count, trained from labelled samples: random strings
made by a hash (label 1), and the words of at most ``train_docs`` texts labelled
good, alone and joined into identifiers (label 0). A candidate whose log ratio
exceeds ``MIN_TOTAL`` and ``MIN_MEAN`` a transition, and that touches no base
span, is added as kind ``markov``.

Offsets of matches follow from the lengths of what the pattern matches and of
what lies between, so no match position is searched for twice. All folds over
matches are running sums, maxima or minima in pieces of ``PIECE`` (``running``),
and a token is split into its characters once, so the time grows with the length
of a text and the number of its matches, however long a token is.

Defined results: a null text has no spans and counts as empty; offsets count
code points; very long texts, tokens and lists of matches are taken whole;
repeated rows and ids give a row each, with equal spans for equal texts; a table
without rows gives none; columns of the input other than id and text aren't
read, so their names can't clash; without labelled texts the ordinary model is
uniform; of labels that tie in their hash the least id trains.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in order, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # of 16 characters or more: the same spans as of AKIA[A-Z0-9]+ with shorter ones dropped
HEX = r"[0-9a-f]{32,}"  # likewise
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_SECRET = 8
MIN_TOTAL, MIN_MEAN = 8.0, 0.35
TRAIN_DOCS, RANDOM_STRINGS = 300, 4000
SYMBOLS = 54  # a-z, A-Z, digit, mark
PIECE = 256
SPANS = "array<struct<start:int,end:int,token:string>>"
FAR = 2**31 - 1


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Inclusive running results of an associative ``op`` over array<long>, in two levels.

    Appending to an array copies it, so no fold appends more than ``PIECE`` entries at the lower
    level; at the upper one there is an entry for each piece.
    """

    def fold(array: Column) -> Column:
        start = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            return let(op(state["at"], x), lambda v: F.struct(v.alias("at"), F.array_append(state["out"], v).alias("out")))

        return F.aggregate(array, start, step, lambda state: state["out"])

    def pieces(v: Column) -> Column:
        each = F.sequence(F.lit(1), F.size(v), F.lit(PIECE))
        return let(
            F.transform(each, lambda i: fold(F.slice(v, i, PIECE))),
            lambda parts: let(
                fold(F.transform(parts, lambda p: F.element_at(p, -1))),
                lambda ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(let(F.element_at(ends, i), lambda before: F.transform(p, lambda x: op(before, x)))))),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, pieces(v)).otherwise(F.array().cast("array<long>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start,end,token>> of the leftmost non-overlapping matches, in code points."""

    def spans(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        ends = running(F.zip_with(between, F.transform(found, lambda x: F.length(x).cast("long")), lambda b, n: b + F.coalesce(n, F.lit(0))), _sum, 0)
        return F.zip_with(found, F.slice(ends, 1, F.size(found)), lambda x, end: F.struct((end - F.length(x)).cast("int").alias("start"), end.cast("int").alias("end"), x.alias("token")))

    return let(_found(text, pattern), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(F.array().cast(SPANS)))


def _if_any(text: Column, pattern: str, spans: Column) -> Column:
    """Positions are worked out only for texts in which the pattern occurs."""
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def symbols(token: Column) -> Column:
    """0 to 53 for each character."""

    def symbol(char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code.between(97, 122), code - 97).when(code.between(65, 90), code - 39).when(code.between(48, 57), 52).otherwise(53)

    return F.transform(F.split(token, ""), symbol)


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled 1: base64, mixed-case alphanumeric, capital alphanumeric and hexadecimal strings made by a hash."""
    raw = spark.range(n).select("id", F.base64(F.unhex(F.sha2(F.concat(F.lit("secret"), "id"), 256))).alias("b"), F.sha2(F.concat(F.lit("hex"), "id"), 256).alias("h"))
    alnum = F.regexp_replace("b", "[^A-Za-z0-9]", "")
    kind = F.col("id") % 4
    return raw.select(F.when(kind == 0, F.col("b")).when(kind == 1, alnum).when(kind == 2, F.upper(alnum)).otherwise(F.substring("h", 1, 40)).alias("token"), F.lit(1).alias("random"))


def ordinary_strings(documents: DataFrame, good: DataFrame, id_col: str, text_col: str, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Labelled 0: words of labelled texts, alone and joined in pairs as identifiers."""
    some = good.filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(train_docs).select(id_col)
    texts = documents.select(id_col, text_col).join(F.broadcast(some), id_col)  # at most train_docs ids
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[A-Za-z][A-Za-z_-]{3,}"), F.lit(0))
    words = texts.select(F.explode(words).alias("w"))
    joined = F.array("w", F.concat_ws("_", F.lower("w"), F.lower("w")), F.concat(F.lower("w"), F.initcap(F.col("w"))), F.concat_ws("-", F.lower("w"), F.lower("w"), F.lit("2024")))
    return words.select(F.explode(joined).alias("token"), F.lit(0).alias("random"))


def train_ratio(samples: DataFrame) -> list[float]:
    """ln P(next | this) under the random model less that under the ordinary one, by this * SYMBOLS + next."""
    pair = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: x * SYMBOLS + y)
    pairs = samples.filter(F.length("token") > 1).select("random", F.explode(let(symbols(F.col("token")), pair)).alias("pair"))
    counts = [[1.0] * SYMBOLS * SYMBOLS, [1.0] * SYMBOLS * SYMBOLS]
    for row in pairs.groupBy("random", "pair").count().collect():  # at most 2 * 54 * 54 rows
        counts[row["random"]][row["pair"]] += row["count"]
    rows = [[sum(c[k * SYMBOLS : (k + 1) * SYMBOLS]) for k in range(SYMBOLS)] for c in counts]
    return [log(counts[1][p] / rows[1][p // SYMBOLS]) - log(counts[0][p] / rows[0][p // SYMBOLS]) for p in range(SYMBOLS * SYMBOLS)]


def log_ratio(token: Column, ratio: Column) -> Column:
    """Sum of the ratios of all neighbouring characters."""
    none = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(state: Column, c: Column) -> Column:
        more = F.when(state["before"] < 0, F.lit(0.0)).otherwise(F.element_at(ratio, state["before"] * SYMBOLS + c + 1))
        return F.struct(c.alias("before"), (state["sum"] + more).alias("sum"))

    return F.aggregate(symbols(token), none, step, lambda state: state["sum"])


def outside(spans: Column, base: Column) -> Column:
    """Those ``spans`` that overlap none of ``base`` (both array<struct<start,end>>), by one pass over all in order."""
    tagged = lambda x, own: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end")))

    def free(every: Column) -> Column:
        reach = running(F.transform(every, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0).cast("long")), F.greatest, 0)
        ahead = F.reverse(running(F.transform(F.reverse(every), lambda s: F.when(s["own"] == 0, s["start"]).otherwise(FAR).cast("long")), F.least, FAR))
        rows = F.arrays_zip(every.alias("s"), reach.alias("reach"), ahead.alias("ahead"))
        kept = F.filter(rows, lambda r: (r["s"]["own"] == 1) & (r["reach"] <= r["s"]["start"]) & (r["ahead"] >= r["s"]["end"]))
        return F.transform(kept, lambda r: F.struct(r["s"]["start"].alias("start"), r["s"]["end"].alias("end")))

    both = (F.size(spans) > 0) & (F.size(base) > 0)
    return F.when(both, let(F.array_sort(F.concat(tagged(base, 0), tagged(spans, 1))), free)).otherwise(spans)


def _with_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    named = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"]))
    return F.array_join(named, ",")


def scan_secrets(df: DataFrame, ratio: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_markov, base, spans (both ``kind:start:end`` by start, then kind)."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    secret = lambda token: F.length(F.regexp_extract(token, ASSIGN, 2)) >= MIN_SECRET
    assign = _plain(F.filter(spans_of(text, ASSIGN), lambda s: secret(s["token"])))
    t = t.withColumns({"assign": _if_any(text, ASSIGN, assign), "access": _if_any(text, ACCESS, _plain(spans_of(text, ACCESS))), "hex": _if_any(text, HEX, _plain(spans_of(text, HEX)))})

    def odd(s: Column) -> Column:
        return let(log_ratio(s["token"], table), lambda llr: (llr > MIN_TOTAL) & (llr > MIN_MEAN * (s["end"] - s["start"] - 1)))

    t = t.withColumn("candidates", _if_any(text, CANDIDATE, _plain(F.filter(spans_of(text, CANDIDATE), odd))))
    t = t.withColumn("markov", outside(F.col("candidates"), F.concat("assign", "access", "hex")))
    kinds = {k: _with_kind(F.col(k), n + 1) for n, k in enumerate(KINDS)}
    base = F.concat(*[kinds[k] for k in KINDS[:3]])
    return t.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.size("markov").cast("long").alias("n_markov"),
        _joined(base).alias("base"), _joined(F.concat(base, kinds["markov"])).alias("spans"),
    )
