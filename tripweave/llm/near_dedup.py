"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words are counted over all texts in a sketch of fixed size
   (``CELLS`` counters), which gives every shingle an idf: ``FLOOR`` +
   (1 - ``FLOOR``) * ln(N / df) / ln(N). What a counter holds above the common
   load of all counters is the frequency; what does not rise out of their spread
   counts as rare, so a crowded sketch adds no noise. The floor keeps what many
   copies share from vanishing against what an edit adds: with a lower one,
   large groups of near copies fall apart.
2. Each text draws ``BANDS * ROWS`` consistent weighted samples (Ioffe's
   improved scheme): two texts agree in a sample with the probability of their
   weighted Jaccard similarity. Equal texts collapse into one node first.
3. Nodes that share a band form a bucket. The leader of a bucket is the member
   whose buckets are largest: in a group of copies that is the text nearest to
   all others. Each node meets the strongest of its leaders, and the two members
   of a bucket of two meet.
4. In buckets that then still hold more than one class, members of different
   classes meet. Buckets of more than ``GROUP`` members or ``GROUP_CHARS``
   characters are dealt into pairs of blocks: whoever is outside the largest
   class meets all, so no group is unbounded and no bucket is capped. The work
   on a large bucket grows with its members times those outside its largest class.
5. A pair that met becomes a link when the exact weighted Jaccard similarity of
   the two whole texts is at least ``threshold``. Pairs that agree in fewer than
   ``SCREEN`` of the samples (five standard deviations below) are passed over.
6. Classes are the connected components of the links: partitions contract their
   edges by union-find, and rounds of minima join what is left.

Defined results: texts without words (null, empty, white space) are in a class
only with texts equal to them (null counts as empty); texts of one to four
words have one shingle of all their words; very long texts count whole, and two
of them form a group even beyond ``GROUP_CHARS``; equal similarities need no
order, as classes don't depend on it; repeated rows are in one class; null ids
sort last; an empty table gives an empty result. Columns of the input never
clash with working columns, because only id and text are read, and ``keep_one``
returns the input's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, cut, row_hash
from tripweave.llm.exact_dedup import maybe_in
from tripweave.llm.textbatch import CHUNK_ROWS, U, TextBatch, chunks, mix64, shingle_sets

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
SCREEN = 0.55
GROUP, GROUP_CHARS = 1024, 8_000_000
FAN = 4096  # members that meet one copy of a leader
FLOOR = 0.8
SPREAD = 6.0  # standard deviations by which a counter must rise above the common load
CELL_BITS = 20
CELLS = 1 << CELL_BITS
SLICE = 4096  # counters in a row of the sketch
EDGES = 1_000_000  # contracted at once
_SALT = mix64(np.arange(1, SAMPLES + 1, dtype=np.int64).view(U) * U(0x9E3779B97F4A7C15))


def _uniform_tables() -> tuple[np.ndarray, ...]:
    """Variates by 16-bit index: r and ln c of Gamma(2, 1), and beta of U(0, 1)."""
    rng = np.random.default_rng(7)
    u = (np.arange(65536) + 0.5) / 65536
    gamma = np.sort(rng.gamma(2.0, 1.0, 1 << 20))[8::16]  # quantiles of Gamma(2, 1)
    r = gamma.astype(np.float32)
    log_c = np.log(gamma).astype(np.float32)
    return r, log_c, u.astype(np.float32)


_R, _LOG_C, _BETA = _uniform_tables()


def cell(shingle: np.ndarray) -> np.ndarray:
    return (shingle & U(CELLS - 1)).astype(np.int64)


# ---------------------------------------------------------------- idf


def idf_of(counts: np.ndarray, n: int) -> np.ndarray:
    """The idf of every cell from the texts counted in it, of ``n`` texts in all."""
    load = np.median(counts)
    spread = max(1.4826 * np.median(np.abs(counts - load)), np.sqrt(load))
    frequency = np.where(counts > load + SPREAD * spread, np.clip(counts - load, 1, max(n, 1)), 1)
    return (FLOOR + (1 - FLOOR) * np.log(max(n, 1) / frequency) / max(np.log(max(n, 2)), 1e-9)).astype(np.float32)


def idf_table(df: DataFrame, text_col: str) -> np.ndarray:
    """The idf of every cell, float32: CELLS * 4 = 4 MB whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                cells += np.bincount(cell(shingle_sets(TextBatch(texts), SHINGLE)[1]), minlength=CELLS).astype(np.uint32)
                n += len(texts)
        if n:
            full = cells.reshape(-1, SLICE)
            some = np.flatnonzero(full.any(axis=1))
            pick = int(mix64(np.array([cells.sum(dtype=np.uint64) + U(n)]))[0] % U(64))
            yield pa.RecordBatch.from_pydict({"slice": some.astype(np.int32), "pick": np.full(len(some), pick, np.int32), "counts": [x.tobytes() for x in full[some]], "n": np.full(len(some), 0, np.int64)})
            yield pa.RecordBatch.from_pydict({"slice": np.array([-1], np.int32), "pick": np.array([pick], np.int32), "counts": [np.zeros(SLICE, np.uint32).tobytes()], "n": np.array([n], np.int64)})

    kind = "slice int, pick int, counts binary, n long"

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.uint64)
        for x in rows["counts"]:
            total += np.frombuffer(x, np.uint32 if len(x) == 4 * SLICE else np.uint64)
        return pd.DataFrame({"slice": [int(rows["slice"].iloc[0])], "pick": [0], "counts": [total.tobytes()], "n": [int(rows["n"].sum())]})

    parts = df.select(text_col).mapInArrow(count, kind)
    # Two levels, so that no group gathers a row from every task.
    sums = parts.groupBy("slice", "pick").applyInPandas(add, kind).groupBy("slice").applyInPandas(add, kind)
    counts, n = np.zeros((CELLS // SLICE, SLICE), np.float64), 0
    for row in sums.select("slice", "counts", "n").collect():  # at most CELLS / SLICE + 1 rows of 32 KB
        if row["slice"] < 0:
            n = row["n"]
        else:
            counts[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
    return idf_of(counts.reshape(-1), n)


# ---------------------------------------------------------------- samples


def weighted_sets(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all texts."""
    doc, shingle, times = shingle_sets(TextBatch(texts), SHINGLE)
    return doc, shingle, times * idf[cell(shingle)]


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which texts have any shingle, their SAMPLES 32-bit samples)."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((0, SAMPLES), np.int32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, len(doc)))
    out = np.empty((len(first), SAMPLES), np.int32)
    step = 60_000  # items at once: what stays in cache
    edges = [0]
    while edges[-1] < len(first):
        i = edges[-1]
        edges.append(max(i + 1, int(np.searchsorted(first, first[i] + step, side="right")) - 0 if first[i] + step < len(doc) else len(first)))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        a, b = first[i], first[j] if j < len(first) else len(doc)
        out[i:j] = _samples(shingle[a:b], np.log(weight[a:b]).astype(np.float32), first[i:j] - a, size[i:j])
    return doc[first], out


def _samples(shingle: np.ndarray, log_weight: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty((len(first), SAMPLES), np.int32)
    base = mix64(shingle)
    for k in range(SAMPLES):
        with np.errstate(over="ignore"):
            h = (base ^ _SALT[k]) * U(0xBF58476D1CE4E5B9)
            h ^= h >> U(29)
            h *= U(0x94D049BB133111EB)
        r = _R[h >> U(48)]
        beta = _BETA[(h >> U(32)) & U(0xFFFF)]
        t = np.floor(log_weight / r + beta)
        a = _LOG_C[(h >> U(16)) & U(0xFFFF)] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, first)
        hit = np.flatnonzero(a == np.repeat(least, size))
        at = hit[np.searchsorted(hit, first)]
        with np.errstate(over="ignore"):
            out[:, k] = (mix64(base[at] + t[at].astype(np.int64).view(U) * U(0xD1342543DE82EF95)) >> U(32)).astype(np.uint32).view(np.int32)
    return out


def text_node(text: Column) -> Column:
    """A node stands for all equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sample_nodes(df: DataFrame, idf: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, node, chars, samples); samples are null for texts without a word."""

    def run(batches):
        table = idf.value
        for batch in batches:
            for at, texts in chunks(batch.column(3)):
                who, drawn = samples(*weighted_sets(texts, table), len(texts))
                has = np.zeros(len(texts), bool)
                has[who] = True
                offsets = np.concatenate([[0], np.cumsum(has * SAMPLES)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(drawn.reshape(-1)), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in batch.columns[:3]], lists], names=["id", "node", "chars", "samples"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    read = df.select(F.col(id_col).alias("id"), text_node(text).alias("node"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), text)
    return read.mapInArrow(run, f"id {kind}, node binary, chars long, samples array<int>")


def numbered_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node: nid (a number within this run), node, id (the least), n, chars, samples."""
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("chars").alias("chars"), F.first("samples").alias("samples"))
    return nodes.withColumn("nid", F.monotonically_increasing_id())


# ---------------------------------------------------------------- candidates


def buckets_of(nodes: DataFrame, tables: Scratch) -> DataFrame:
    """(nid, chars, bucket, n, lead, strength): members of buckets of two or more with their leader, whose buckets have ``strength`` members in all."""
    hashes = F.array(*[F.xxhash64(F.lit(b), F.slice("samples", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    keys = nodes.filter("samples IS NOT NULL").select("nid", "chars", F.explode(hashes).alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    own = keys.join(sizes, "bucket").groupBy("nid", "chars").agg(F.sum("n").alias("strength"), F.collect_list(F.struct("bucket", "n")).alias("own"))  # at most BANDS each
    members = tables.keep(own.select("nid", "chars", "strength", F.inline("own")))
    leads = members.groupBy("bucket").agg(F.max(F.struct("strength", (-F.col("nid")).alias("rev"))).alias("top"))
    leads = leads.select("bucket", (-F.col("top.rev")).alias("lead"), F.col("top.strength").alias("strength"))
    return tables.keep(members.drop("strength").join(leads, "bucket"))


def texts_of(members: DataFrame, nodes: DataFrame, df: DataFrame, text_col: str, tables: Scratch) -> DataFrame:
    """(nid, samples, text) of all members; a Bloom filter keeps most other texts from being shuffled."""
    wanted = tables.keep(members.select("nid").distinct().join(nodes.select("nid", "node", "samples"), "nid"))
    texts = df.select(text_node(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.filter(maybe_in(wanted, "node")).groupBy("node").agg(F.first("text").alias("text"))
    return tables.keep(texts.join(wanted, "node").select("nid", "samples", "text"))


def led_pairs(members: DataFrame) -> DataFrame:
    """(nid, lead, n): each node with the strongest of its leaders, and the members of buckets of two."""
    best = members.groupBy("nid").agg(F.max_by(F.struct("lead", "n"), F.struct("strength", -F.col("lead"), "n")).alias("best")).select("nid", "best.*")
    twos = members.filter("n = 2").select("nid", "lead", "n")
    return best.union(twos).filter("nid <> lead").groupBy("nid", "lead").agg(F.max("n").alias("n"))


def met_links(pairs: DataFrame, known: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Links (a, b) among pairs (nid, lead, n). A leader of many is copied, ``FAN`` members to a copy, so that no task meets all of them."""
    copies = lambda n: F.ceil(n / FAN)
    left = pairs.withColumn("salt", F.pmod(F.xxhash64("nid"), copies(F.col("n")))).select("nid", "lead", "salt")
    leads = pairs.groupBy("lead").agg(F.max("n").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("n")) - 1)))
    leads = leads.select("lead", "salt").join(known.select(F.col("nid").alias("lead"), F.col("samples").alias("ls"), F.col("text").alias("lt")), "lead")
    both = left.join(known, "nid").join(leads, ["lead", "salt"]).select("lead", "nid", "ls", "samples", "lt", "text")
    return both.mapInArrow(lambda batches: (out for b in batches for out in _verified(b, idf.value, threshold)), "a long, b long")


def _verified(batch: pa.RecordBatch, idf: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) whose samples pass the screen and whose exact weighted Jaccard similarity reaches the threshold."""
    drawn = [c.flatten().to_numpy().reshape(-1, SAMPLES) for c in batch.columns[2:4]]
    batch = batch.filter(pa.array((drawn[0] == drawn[1]).sum(axis=1) >= int(SCREEN * SAMPLES)))
    a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    sizes = np.cumsum(np.add(*[pc.utf8_length(c).to_numpy() for c in batch.columns[4:6]])) if len(a) else a
    at = 0
    while at < len(a):
        to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 1_000_000)) + 1
        to = min(to, at + CHUNK_ROWS, len(a))
        left, right = (c.slice(at, to - at).to_pylist() for c in batch.columns[4:6])
        hit = weighted_jaccard(left, right, idf) >= threshold
        yield pa.RecordBatch.from_pydict({"a": np.minimum(a[at:to], b[at:to])[hit], "b": np.maximum(a[at:to], b[at:to])[hit]})
        at = to


def weighted_jaccard(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    n = len(left)
    da, sa, wa = weighted_sets(left, idf)
    db, sb, wb = weighted_sets(right, idf)
    key = np.concatenate([(da.astype(U) << U(48)) | sa, (db.astype(U) << U(48)) | sb])
    weight = np.concatenate([wa, wb]).astype(np.float64)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    low = np.minimum(weight[order[same]], weight[order[same + 1]])
    shared = np.bincount((key[order[same]] >> U(48)).astype(np.int64), low, n)
    total = np.bincount(da, wa, n) + np.bincount(db, wb, n)
    return shared / np.maximum(total - shared, 1e-30)


def mixed_groups(members: DataFrame, root: DataFrame, tables: Scratch) -> DataFrame:
    """(nid, bucket, root, side): groups of bounded size in which members of different classes of a bucket meet.

    Buckets of the same members count once; those of two have met. A bucket of at most ``GROUP`` members and
    ``GROUP_CHARS`` characters is one group (side 0). In a larger one, of two members in different classes at
    least one is outside the largest class: those (side 1) are dealt into blocks, and so are all members (side 2),
    and each block of the first meets each of the second. A block has about a quarter of what a group may have.
    """
    rows = members.filter("n > 2").select("nid", "chars", "bucket").join(root, "nid", "left")
    rows = tables.keep(rows.withColumn("root", F.coalesce("root", "nid")))
    marks = [F.bit_xor(F.xxhash64("nid", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    by_class = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), *marks)
    sums = [F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.bit_xor("mark0").alias("mark0"), F.bit_xor("mark1").alias("mark1")]
    whole = by_class.groupBy("bucket").agg(F.max(F.struct("n", "root", "chars")).alias("main"), *sums).filter("main.n < n")
    once = whole.groupBy("n", "chars", "mark0", "mark1").agg(F.min_by(F.struct("bucket", "main"), "bucket").alias("one"))
    needed = lambda n, chars: F.ceil(F.greatest(n * 4 / GROUP, chars * 4 / GROUP_CHARS, F.lit(1))).cast("int")
    n, chars, main = F.col("n"), F.col("chars"), F.col("one.main")
    small = (n <= GROUP) & (chars <= GROUP_CHARS)
    plan = once.select(F.col("one.bucket").alias("bucket"), main["root"].alias("main"), small.alias("small"), needed(n - main["n"], chars - main["chars"]).alias("k1"), needed(n, chars).alias("k2"))
    rows = rows.select("nid", "bucket", "root").join(plan, "bucket")
    deal = lambda k: F.pmod(F.xxhash64("nid"), F.col(k)).cast("int")
    each = lambda k, f: F.transform(F.sequence(F.lit(0), F.col(k) - 1), f)
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    first = F.when(F.col("root") != F.col("main"), each("k2", lambda y: place(deal("k1"), y, 1)))
    second = each("k1", lambda x: place(x, deal("k2"), 2))
    places = F.when(F.col("small"), F.array(place(F.lit(0), F.lit(0), 0))).otherwise(F.concat(F.coalesce(first, F.filter(second, lambda _: F.lit(False))), second))
    rows = rows.select("nid", "bucket", "root", F.inline(places))
    return rows.select("nid", F.xxhash64("bucket", "x", "y").alias("bucket"), "root", "side")


def links_within(members: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) that join different classes within a group; at most one fewer than its members.

    Members are compared exactly where they agree in ``SCREEN`` of the samples and are not yet in one class:
    each of side 0 with each other, each of side 1 with each of side 2.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "nid"])
        drawn = np.stack(rows["samples"].to_numpy())
        nid, side = rows["nid"].to_numpy(), rows["side"].to_numpy()
        _, top, size = np.unique(rows["root"].to_numpy(), return_inverse=True, return_counts=True)
        sets = [weighted_sets(texts, idf.value) for _, texts in chunks(pa.array(rows["text"]))]
        at = np.cumsum([0, *[len(t) for _, t in chunks(pa.array(rows["text"]))]])
        doc = np.concatenate([d + k for (d, _, _), k in zip(sets, at, strict=False)])
        shingle, weight = np.concatenate([x[1] for x in sets]), np.concatenate([x[2] for x in sets]).astype(np.float64)
        shingle, code = np.unique(shingle, return_inverse=True)
        bound = np.searchsorted(doc, np.arange(len(nid) + 1))
        total = np.bincount(doc, weight, len(nid))
        main = top == size.argmax()
        who = np.flatnonzero((side == 1) | ((side == 0) & ~main))
        own = np.zeros(len(shingle))
        place = np.arange(len(nid))
        a, b = [], []
        for i in who:
            meets = (side == 2) if side[i] else (main | (place > i))
            near = np.flatnonzero(meets & (top != top[i]))
            near = near[(drawn[near] == drawn[i]).sum(axis=1) >= int(SCREEN * SAMPLES)]
            if not len(near):
                continue
            mine = slice(bound[i], bound[i + 1])
            own[code[mine]] = weight[mine]
            count = bound[near + 1] - bound[near]
            items = np.arange(count.sum()) + np.repeat(bound[near] - (np.cumsum(count) - count), count)
            shared = np.bincount(np.repeat(np.arange(len(near)), count), np.minimum(own[code[items]], weight[items]), len(near))
            own[code[mine]] = 0
            for j in near[shared >= threshold * (total[i] + total[near] - shared)]:
                if top[j] != top[i]:
                    a.append(min(nid[i], nid[j]))
                    b.append(max(nid[i], nid[j]))
                    top[top == top[j]] = top[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return members.groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def links(nodes: DataFrame, df: DataFrame, text_col: str, idf: Broadcast, threshold: float, tables: Scratch) -> DataFrame:
    """Verified pairs (a, b) of nodes, enough to connect every class."""
    members = buckets_of(nodes, tables)
    known = texts_of(members, nodes, df, text_col, tables)
    found = tables.keep(met_links(led_pairs(members), known, idf, threshold))
    groups = mixed_groups(members, components(found, tables), tables)
    return found.union(tables.keep(links_within(groups.join(known, "nid"), idf, threshold)))


# ---------------------------------------------------------------- classes


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that edges connect it to) of all ends of the edges."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """(nid, root): the least node of each connected component of edges (a, b).

    Each task contracts its edges, ``EDGES`` at a time, to stars. A node with
    several centres links them for the next round; every round lowers a centre
    until each node has one.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            ids, root = contracted(*(np.concatenate([h[k] for h in held]) for k in range(2)))
            return pa.RecordBatch.from_pydict({"nid": ids, "root": root})

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= EDGES:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    while True:
        few = 1 + edges.count() // EDGES
        part = tables.keep(edges.select("a", "b").coalesce(few).mapInArrow(stars, "nid long, root long"))
        # One root for each flush that a node is in.
        if few == 1 or part.groupBy("nid").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").isEmpty():
            return part.groupBy("nid").agg(F.min("root").alias("root"))
        roots = part.groupBy("nid").agg(F.sort_array(F.collect_set("root")).alias("roots"))
        edges = roots.select(F.explode(F.array_union(F.array("nid"), "roots")).alias("b"), F.col("roots")[0].alias("a")).filter("a <> b")
        edges = tables.keep(edges.distinct())


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float, tables: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, root)."""
    idf = df.sparkSession.sparkContext.broadcast(idf_table(df, text_col))
    try:
        rows = tables.keep(sample_nodes(df, idf, id_col, text_col))
        nodes = tables.keep(numbered_nodes(rows))
        root = components(links(nodes, df, text_col, idf, threshold, tables), tables)
    finally:
        idf.destroy()
    return rows, nodes, root


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, class_id (least id of the class), class_size, text_copies."""
    tables = Scratch(df.sparkSession)
    try:
        rows, nodes, root = _classes(df, id_col, text_col, threshold, tables)
        named = tables.keep(nodes.select("nid", "node", "id", "n").join(root, "nid", "left").select("node", "id", "n", F.coalesce("root", "nid").alias("root")))
        classes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
        named = named.join(classes, "root").select("node", "class_id", "class_size", F.col("n").alias("text_copies"))
        return cut(rows.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "class_id", "class_size", "text_copies"))
    finally:
        tables.close()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the least id, with the columns of ``df``.

    Rows that tie in the id are told apart by their text, then by all columns.
    """
    tables = Scratch(df.sparkSession)
    try:
        _, nodes, root = _classes(df, id_col, text_col, threshold, tables)
        root = root.join(nodes.select("nid", "node", "id"), "nid")
        best = F.min_by("nid", F.struct(F.col("id").isNull(), F.col("id"), F.col("node")))
        # Texts that are not the best of their class go; rows of one text collapse.
        worse = root.join(root.groupBy("root").agg(best.alias("nid")).select("nid"), "nid", "left_anti").select("node")
        worse = tables.keep(worse)
        folded = nodes.filter("n > 1").join(worse, "node", "left_anti").select("node", F.lit(True).alias("fold"))
        special = cut(worse.withColumn("fold", F.lit(False)).unionByName(folded))
    finally:
        tables.close()
    cols = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(F.struct(*cols).alias("row"), text_node(F.col(text_col)).alias("node")).withColumn("maybe", maybe_in(special, "node"))
    suspect = keyed.filter("maybe").join(special, "node", "left")
    own = F.col(f"row.`{id_col}`")
    rank = F.struct(own.isNull(), own, row_hash(df, "row"))
    one = suspect.filter("fold").groupBy("node").agg(F.min_by("row", rank).alias("row"))
    clear = keyed.filter(~F.col("maybe")).select("row").union(suspect.filter("fold IS NULL").select("row"))
    return clear.union(one.select("row")).select("row.*")
