"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF.

Each line with a word gets numeric features (shares of symbols, capitals,
digits and marks, size, repetition). A conditional random field with two
labels scores a line by a weight for each feature and neighbouring lines by a
transition matrix; Viterbi decoding finds the best labelling. The share of a
text's words in content lines decides whether it stays.

The CRF is trained by maximum likelihood with a weak Gaussian prior around
``PRIOR`` (gradient ascent on the forward-backward expectations) on at most ``train_per_class`` labelled texts of
each class, those with the smallest hash of their id: lines of good texts count
as content, lines of bad texts as boilerplate. Texts that fail the base rules
take no part, for their lines may be well formed. If a class has no text, the
fixed weights ``PRIOR`` serve.

Defined results: a null or empty text has no words, fails the base rules and
goes; lines without a word get no label; very long texts and lines count whole;
equal rows are judged alike; labellings that tie take boilerplate; an empty table
gives an empty result; columns of the input pass unchanged through ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.textbatch import TextBatch, chunks, repeated

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_CONTENT_SHARE = 0.5
TRAIN_PER_CLASS = 300
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "short", "repeated", "pipes", "word_length", "stutter")


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS = _flags("#*$%&|<>")
CAPITALS = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = _flags("0123456789")
MARKS = _flags("!?;:/\\_=+~^@[]{}")
PIPES = _flags("|")
CHARACTER = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Crf:
    weights: tuple[float, ...]  # content minus boilerplate, for each feature
    transitions: tuple[float, float, float, float]  # from boilerplate to boilerplate, to content; from content likewise


#: The weights used when there is nothing to train on.
PRIOR = Crf((3.0, -40.0, -8.0, -4.0, -20.0, -0.5, -1.0, -40.0, -0.5, -8.0), (1.0, -1.0, -1.0, 1.0))


def line_table(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that have a word: (text, words, features, equals an earlier line of its text)."""
    breaks = np.flatnonzero(b.data == 10)
    start = np.concatenate([[0], breaks[:-1] + 1])
    words = b.count(_at(b.start, len(b.data)), start, breaks)
    start, end, words = start[words > 0], breaks[words > 0], words[words > 0]
    doc = np.searchsorted(b.to, start)
    h = b.spans(start, end)
    order = np.lexsort((start, h, doc))
    dup = np.zeros(len(start), bool)
    if len(order):
        dup[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    h = b.words()
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (b.doc[1:] == b.doc[:-1])])[: len(h)]
    stutter = b.count(_at(b.start[again], len(b.data)), start, end)
    chars = np.maximum(b.count(CHARACTER[b.data] & b.in_word, start, end), 1)
    share = lambda flags: b.count(flags[b.data], start, end) / chars
    x = np.stack(
        [np.ones(len(start)), share(SYMBOLS), share(CAPITALS), share(DIGITS), share(MARKS), words < 4, dup, share(PIPES), np.minimum(chars / words / 10, 3), stutter / words], axis=1
    ).astype(np.float64)
    return doc, words, x, dup


def _at(positions: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[positions] = True
    return out


def viterbi(doc: np.ndarray, score: np.ndarray, transitions) -> np.ndarray:
    """Best labels (0 boilerplate, 1 content) of all sequences at once.

    ``doc`` is sorted; ``score`` is what content scores above boilerplate.
    """
    t = np.asarray(transitions, np.float64).reshape(2, 2)
    n = len(doc)
    label = np.zeros(n, np.int8)
    if not n:
        return label
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    back = np.zeros((n, 2), np.int8)
    best = np.zeros((len(first), 2))
    best[:, 1] = score[first]
    alive = len(first)
    last = np.zeros(len(first), np.int8)
    for p in range(1, int(length[0]) + 1):
        while alive and length[alive - 1] < p + 1:
            alive -= 1
            last[alive] = best[alive, 1] > best[alive, 0]
        if not alive:
            break
        at = first[:alive] + p
        via = best[:alive, :, None] + t[None]
        back[at] = via.argmax(axis=1)
        best[:alive] = via.max(axis=1)
        best[:alive, 1] += score[at]
    alive = 0
    for p in range(int(length[0]) - 1, -1, -1):
        while alive < len(first) and length[alive] > p:
            alive += 1
        at = first[:alive] + p
        label[at] = last[:alive]
        last[:alive] = back[at, last[:alive]]
    return label


def train_crf(sequences: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.3, penalty: float = 1e-3) -> Crf:
    """Maximum likelihood on (features of the lines, label of all of them)."""
    if len({y for _, y in sequences}) < 2:
        return PRIOR
    f = len(FEATURES)
    scale = np.abs(np.concatenate([x for x, _ in sequences])).max(axis=0)
    scale[scale == 0] = 1
    size = max(len(x) for x, _ in sequences)
    xs, mask, ys = np.zeros((len(sequences), size, f)), np.zeros((len(sequences), size), bool), np.array([y for _, y in sequences])
    for i, (x, _) in enumerate(sequences):
        xs[i, : len(x)], mask[i, : len(x)] = x / scale, True
    # Each class weighs the same, and each text as much as another.
    weight = np.where(ys == 1, 0.5 / max((ys == 1).sum(), 1), 0.5 / max((ys == 0).sum(), 1))
    prior = np.array(PRIOR.weights) * scale
    w, t = prior.copy(), np.array(PRIOR.transitions).reshape(2, 2)
    m = [np.zeros(f), np.zeros((2, 2))]
    v = [np.zeros(f), np.zeros((2, 2))]
    lines = mask.sum(axis=1)
    for step in range(1, steps + 1):
        content, pairs = _expectations(xs @ w, t, mask)
        each = weight / lines
        gw = ((((ys[:, None] - content) * mask) * each[:, None])[:, :, None] * xs).sum(axis=(0, 1)) - penalty * (w - prior)
        observed = np.zeros_like(pairs)
        observed[np.arange(len(ys)), ys, ys] = lines - 1
        gt = ((observed - pairs) * each[:, None, None]).sum(axis=0) - penalty * t
        for k, g in enumerate((gw, gt)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            up = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k:
                t = t + up
            else:
                w = w + up
    return Crf(tuple(float(a) for a in w / scale), tuple(float(a) for a in t.ravel()))


def _expectations(score: np.ndarray, t: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each line and the expected transitions of each text, by forward-backward."""
    n, size = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    fwd, bwd = np.zeros((n, size, 2)), np.zeros((n, size, 2))
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    fwd[:, 0] = emit[:, 0]
    for p in range(1, size):
        step = lse(fwd[:, p - 1, :, None] + t[None], 1) + emit[:, p]
        fwd[:, p] = np.where(mask[:, p, None], step, fwd[:, p - 1])
    for p in range(size - 2, -1, -1):
        step = lse(t[None] + (emit[:, p + 1] + bwd[:, p + 1])[:, None, :], 2)
        bwd[:, p] = np.where(mask[:, p + 1, None], step, bwd[:, p])
    total = lse(fwd[:, -1], 1)
    content = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None])
    pairs = np.zeros((n, 2, 2))
    for p in range(1, size):
        joint = fwd[:, p - 1, :, None] + t[None] + (emit[:, p] + bwd[:, p])[:, None, :] - total[:, None, None]
        pairs += np.where(mask[:, p, None, None], np.exp(joint), 0)
    return content, pairs


def judge(texts: list[str], crf: Crf) -> dict[str, np.ndarray]:
    """All columns of the verdict for some texts."""
    b = TextBatch(texts)
    doc, words, x, dup = line_table(b)
    sums = lambda who, what: np.bincount(who, what, b.n).astype(np.int64)
    at, h = b.windows(WINDOW)
    hit = at[repeated(b.doc[at], h)]
    n_words = len(b.start)
    cover = np.cumsum(np.bincount(hit, minlength=n_words + WINDOW) - np.bincount(hit + WINDOW, minlength=n_words + WINDOW))[:n_words] > 0
    label = viterbi(doc, x @ np.array(crf.weights), crf.transitions)
    out = {
        "n_words": b.n_words.astype(np.int64),
        "word_chars": b.count(CHARACTER[b.data] & b.in_word, b.from_, b.to),
        "n_symbols": b.count(SYMBOLS[b.data], b.from_, b.to),
        "n_dup_lines": sums(doc, dup),
        "n_repeat_words": sums(b.doc, cover),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["n_lines"], out["n_content_lines"] = sums(doc, np.ones(len(doc))), sums(doc, label)
    out["content_share"] = sums(doc, words * label) / np.maximum(out["n_words"], 1)
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= MIN_CONTENT_SHARE)
    return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_per_class: int = TRAIN_PER_CLASS) -> Crf:
    """The CRF from a bounded sample of the labelled rows (``labels``: id, good 0 or 1)."""
    picked = None
    for good in (0, 1):
        one = labels.filter(F.col("good") == good).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(train_per_class)
        picked = one if picked is None else picked.unionByName(one)

    def features(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                doc, _, x, _ = line_table(TextBatch(texts))
                passed = np.flatnonzero(~judge(texts, PRIOR)["base_failed"])
                good = batch.column(1).to_numpy()[at : at + len(texts)]
                yield pa.RecordBatch.from_pydict({"good": good[passed].astype(np.int32), "x": [x[doc == d].ravel().tolist() for d in passed]})

    # At most 2 * train_per_class ids are broadcast, and as many texts' features come back.
    rows = documents.select(id_col, text_col).join(F.broadcast(picked.select(id_col, "good")), id_col).select(text_col, "good").mapInArrow(features, "good int, x array<double>").collect()
    return train_crf(sorted(((np.array(r["x"]).reshape(-1, len(FEATURES)), r["good"]) for r in rows), key=lambda s: (s[1], s[0].shape, s[0].tobytes())))


def label_quality(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, line labels summed up, and the verdict."""

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                got = judge(texts, crf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(v) for v in got.values()]], names=["id", *got])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns."""
    where = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept = [judge(texts, crf)["kept"] for _, texts in chunks(batch.column(where))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return df.mapInArrow(run, df.schema)
