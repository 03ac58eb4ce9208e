"""Quality classification by hierarchical empirical Bayes.

A logistic classifier over line and word statistics gives each document its
evidence, a log-odds. Sites form two levels: the host (``source``) and the
path under it (``lang``). Outcomes of labelled documents, or the classifier's
probability where there is no label, are summed per path by grouped
aggregation. Each level shrinks toward the one above through a beta prior with
a moment estimate of its strength: path toward host, host toward the global
rate. A document's posterior log-odds are its own evidence plus what its path
has over the global rate, so sparse sites change nothing.

The classifier is fitted on at most ``train_per_class`` labelled texts of each
class (smallest hash of id), by Newton steps with a ridge; sites are counted
over all documents.

Defined results: null and empty texts have the evidence of a text without
words; very long texts count whole; a null source or language is a site of its
own; without two classes of labels the evidence is zero; several labels of one id
are averaged, and repeated rows of an id each count; of training labels that tie
in their hash the least id is taken; an empty table gives an empty result; only
the four named columns are read, so others can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import broadcast_if_small, cut
from tripweave.llm.quality_rules import PRIOR, judge, line_table
from tripweave.llm.textbatch import TextBatch, chunks

TRAIN_PER_CLASS = 500
MIN_POSTERIOR = 0.5
SMALL_PATHS = 20_000  # paths that are broadcast; more are joined by shuffle
FEATURES = 13


@dataclass(frozen=True)
class Logit:
    weights: tuple[float, ...]


def document_features(texts: list[str]) -> np.ndarray:
    """Means of the line features by words, and sizes and repetition of the text."""
    doc, words, x, _ = line_table(TextBatch(texts))
    n = len(texts)
    total = np.maximum(np.bincount(doc, words, n), 1)
    means = np.stack([np.bincount(doc, words * x[:, k], n) / total for k in range(1, x.shape[1])], axis=1)
    base = judge(texts, PRIOR)
    size = np.maximum(base["n_words"], 1)
    more = np.stack([np.ones(n), np.log1p(base["n_words"]), base["n_words"] < 10, np.minimum(base["n_repeat_words"] / size, 1)], axis=1)
    return np.concatenate([more, means], axis=1)


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> Logit:
    if len(set(y.tolist())) < 2:
        return Logit((0.0,) * FEATURES)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    # Weighed to the true share of classes among the labels later, through the site rates.
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return Logit(tuple(float(a) for a in w / scale))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_per_class: int = TRAIN_PER_CLASS) -> Logit:
    """``labels``: id, good. At most 2 * train_per_class feature rows come to the driver."""
    one = lambda g: labels.filter((F.col("good") == g) & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(train_per_class).select(id_col, "good")
    picked = one(0).unionByName(one(1))

    def features(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"good": batch.column(1).slice(at, len(texts)), "x": document_features(texts).tolist()})

    rows = documents.select(id_col, text_col).join(F.broadcast(picked), id_col).select(text_col, F.col("good").cast("int").alias("good")).mapInArrow(features, "good int, x array<double>").collect()
    rows = sorted((r["good"], tuple(r["x"])) for r in rows)
    return fit_logit(np.array([r[1] for r in rows]).reshape(-1, FEATURES), np.array([r[0] for r in rows], float))


def evidence(df: DataFrame, model: Logit, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``logit``."""
    rest = [c for c in df.columns if c != text_col]
    w = np.array(model.weights)

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                logit = np.clip(document_features(texts) @ w, -20, 20)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in batch.columns[1:]], pa.array(logit)], names=[*rest, "logit"])

    out = df.select(rest).withColumn("logit", F.lit(0.0)).schema
    return df.select(text_col, *rest).mapInArrow(run, out)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """(rate, prior strength) of one level by moments, the strength between 1 and 1000."""
    n = F.col("n")
    row = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("b"), F.sum(n * n).alias("nn"), F.sum(F.col("good") ** 2 / n).alias("bb"), F.count("*").alias("j")).first()
    if not row["n"]:
        return 0.5, 1.0
    p = row["b"] / row["n"]
    scale = row["n"] - row["nn"] / row["n"]
    var = (row["bb"] - row["b"] * p - (row["j"] - 1) * p * (1 - p)) / scale if scale > 0 else 0.0
    return p, min(1000.0, max(1.0, p * (1 - p) / var - 1)) if var > 0 else 1000.0


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def classify(df: DataFrame, labels: DataFrame, model: Logit, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Per row: id, p_doc, p_path, p_host, p_good, kept."""
    slim = df.select(F.col(id_col).alias("id"), _key(host_col).alias("host"), _key(path_col).alias("path"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg("good").alias("label"))
    rows = cut(evidence(slim, model).withColumn("p_doc", 1 / (1 + F.exp(-F.col("logit")))).join(known, "id", "left"))
    outcome = F.coalesce("label", "p_doc")
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum(outcome), 6).alias("good")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    (p_all, k_host), (_, k_path) = _strength(hosts), _strength(paths)
    hosts = hosts.select("host", ((F.col("good") + k_host * p_all) / (F.col("n") + k_host)).alias("p_host"))
    paths = paths.join(hosts, "host").select("host", "path", "p_host", ((F.col("good") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_path"))
    paths = cut(paths)
    out = rows.join(broadcast_if_small(paths, paths.count(), SMALL_PATHS), ["host", "path"])
    posterior = F.col("logit") + _logit(F.col("p_path")) - _logit(F.lit(p_all))
    out = out.withColumn("p_good", 1 / (1 + F.exp(-posterior)))
    return out.select(F.col("id").alias(id_col), "p_doc", "p_path", "p_host", "p_good", (F.col("p_good") >= min_posterior).alias("kept"))
