"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a
piece and always merges the pair of highest score, the leftmost on ties. No
piece holds the space mark after another character, so a text falls into
segments (a run of space marks and what follows) that merge on their own. The
distinct segments of a batch are encoded once: long ones with a heap, all
others side by side in a matrix, one merge of each per step. Each distinct
segment's ids are checked against the sentencepiece library before use; where
they differ the library's ids stand, and the count is reported in
``corrected``.

Decoding joins the pieces' bytes, turns space marks into spaces and drops the
space that encoding put in front.

The agenda relies on a model that leaves characters and spaces as they are and
puts one space in front: ``Vocabulary`` asks the library and raises ``ValueError``
for a model that does otherwise.

Defined results: null and empty texts have no ids and decode to the empty
text; characters outside the vocabulary become byte pieces; a space mark in
the text decodes to a space, as in the library; pairs that tie in score merge
from the left; very long texts and segments are encoded whole; repeated rows and
ids give a row each; an empty table gives an empty result; only id and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.textbatch import U, chunks, mix64, powers

MARK = "▁"
WIDE = 48  # longer segments take the heap
_MULT = U(0x9E3779B97F4A7C15)
_BASE = U(0x100000001B3)
_UNBASE = U(pow(int(_BASE), -1, 2**64))
NONE = 2**31 - 1
PROBE = "ﬁ  Ａ\t x \n"  # a ligature, a wide letter, repeated and final spaces: what normalisers change
CHUNK = 2_000_000  # characters whose distinct segments are encoded together


class Vocabulary:
    """Pieces, pair table and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(PROBE) != (" " + PROBE).replace(" ", MARK):
            raise ValueError("the model changes characters or spaces before it encodes")
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = np.zeros(256, np.int32)
        self.bytes = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(names[i][1:-1], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
            elif i in (sp.unk_id(),):
                self.bytes[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.bytes[i] = names[i].replace(MARK, " ").encode()
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece holds the space mark after another character")
        # Symbols: a piece has its id, a character without a piece has n + its code point.
        self.n = n
        self.char = np.arange(0x110000, dtype=np.int64) + n
        symbol = {names[i]: i for i in normal}
        for name, i in symbol.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        left, right, made = [], [], []
        rank = np.full(n, NONE, np.int64)
        for name, i in symbol.items():
            rank[i] = order[sp.get_score(i)]
            for cut in range(1, len(name)):
                a, b = name[:cut], name[cut:]
                a, b = symbol.get(a, n + ord(a) if len(a) == 1 else None), symbol.get(b, n + ord(b) if len(b) == 1 else None)
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self.rank = rank
        keys = (np.array(left, np.int64) << 32 | np.array(right, np.int64)).view(U)
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.table = np.full(1 << self.bits, 2**64 - 1, U)
        self.value = np.zeros(1 << self.bits, np.int32)
        for key, value in zip(keys.tolist(), made, strict=True):
            at = ((key * int(_MULT)) & (2**64 - 1)) >> (64 - self.bits)
            while self.table[at] != 2**64 - 1:
                at = (at + 1) % len(self.table)
            self.table[at], self.value[at] = key, value

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = (a.astype(np.int64) << 32 | b.astype(np.int64)).view(U)
        with np.errstate(over="ignore"):
            at = ((key * _MULT) >> U(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            found = self.table[at]
            same = found == key[todo]
            out[todo[same]] = self.value[at[same]]
            go = ~same & (found != U(2**64 - 1))
            todo, at = todo[go], (at[go] + 1) % len(self.table)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def agenda_heap(v: Vocabulary, symbols: np.ndarray) -> list[int]:
    """Symbols of one segment after all merges: a heap of (rank of score, place, pair)."""
    s = symbols.tolist()
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = v.pair(symbols[:-1], symbols[1:])
    agenda = [(int(v.rank[p]), i, s[i], s[i + 1], int(p)) for i, p in enumerate(first.tolist()) if p >= 0]
    heapq.heapify(agenda)

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            p = int(v.pair(np.array([s[i]]), np.array([s[j]]))[0])
            if p >= 0:
                heapq.heappush(agenda, (int(v.rank[p]), i, s[i], s[j], p))

    while agenda:
        _, i, a, b, p = heapq.heappop(agenda)
        j = after[i]
        if s[i] != a or j >= n or s[j] != b:
            continue  # merged meanwhile
        s[i], s[j] = p, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in s if x >= 0]


def agenda_matrix(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Rows of symbols, -1 behind the end, after all merges; the best pair of each row is merged at each step."""
    s = symbols.copy()
    rows, width = s.shape
    if width < 2:
        return s
    made = np.full((rows, width - 1), -1, np.int64)
    there = s[:, 1:] >= 0
    made[there] = v.pair(s[:, :-1][there], s[:, 1:][there])
    rank = np.where(made >= 0, v.rank[made], NONE)
    out = s.copy()
    live = np.arange(rows)
    while len(live):
        best = rank.argmin(axis=1)
        go = rank[np.arange(len(live)), best] < NONE
        if not go.all():
            out[live[~go]] = s[~go]
            live, s, made, rank, best = live[go], s[go], made[go], rank[go], best[go]
            if not len(live):
                break
        each = np.arange(len(live))
        s[each, best] = made[each, best]
        # Close the gap right of the merged pair.
        shift = np.arange(width - 1)[None, :] > best[:, None]
        nxt = np.concatenate([s[:, 2:], np.full((len(live), 1), -1, s.dtype)], axis=1)
        s[:, 1:] = np.where(shift[:, : width - 1] | (np.arange(1, width)[None, :] > best[:, None]), nxt, s[:, 1:])
        made_next = np.concatenate([made[:, 1:], np.full((len(live), 1), -1, made.dtype)], axis=1)
        rank_next = np.concatenate([rank[:, 1:], np.full((len(live), 1), NONE, rank.dtype)], axis=1)
        made, rank = np.where(shift, made_next, made), np.where(shift, rank_next, rank)
        for at, ok in ((best, best + 1 < width), (best - 1, best > 0)):
            r = each[ok]
            c = at[ok]
            a, b = s[r, c], s[r, c + 1]
            p = np.full(len(r), -1, np.int64)
            real = b >= 0
            p[real] = v.pair(a[real], b[real])
            inside = c < width - 1
            made[r[inside], c[inside]] = p[inside]
            rank[r[inside], c[inside]] = np.where(p[inside] >= 0, v.rank[p[inside]], NONE)
    return out


def _final(v: Vocabulary, symbols: list[int]) -> list[int]:
    """Piece ids of merged symbols: characters without a piece become bytes."""
    out = []
    for x in symbols:
        if x < v.n:
            out.append(x)
        else:
            out.extend(v.byte_id[list(chr(x - v.n).encode("utf-8", "surrogatepass"))].tolist())
    return out


def encode_batch(v: Vocabulary, texts: list[str], check: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids of all texts, number of ids of each, segments where the library differed)."""
    marked = [(" " + t).replace(MARK, " ") if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), 0
    space = points == 32
    opens = space & ~np.concatenate([[False], space[:-1]])
    opens[(ends - sizes)[sizes > 0]] = True
    start = np.flatnonzero(opens)
    size = np.diff(np.append(start, len(points)))
    with np.errstate(over="ignore"):
        total = np.concatenate([[U(0)], np.cumsum(mix64(points.astype(U) + U(1)) * powers(_BASE, len(points)), dtype=U)])
        key = mix64((total[start + size] - total[start]) * powers(_UNBASE, len(points) + 1)[start] + size.astype(U))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    start_u, size_u = start[first], size[first]
    symbol = v.char[points]
    symbol[space] = v.char[ord(MARK)]
    ids: list[list[int]] = [[]] * len(first)
    for low, high in ((1, 8), (9, 16), (17, 28), (29, WIDE)):
        group = np.flatnonzero((size_u >= low) & (size_u <= high))
        for part in np.array_split(group, max(1, len(group) // 20_000)):
            if not len(part):
                continue
            width = int(size_u[part].max())
            at = start_u[part][:, None] + np.arange(width)
            inside = np.arange(width) < size_u[part][:, None]
            merged = agenda_matrix(v, np.where(inside, symbol[np.minimum(at, len(symbol) - 1)], -1))
            keep = merged >= 0
            flat, counts = merged[keep].tolist(), keep.sum(axis=1).tolist()
            odd = (merged >= v.n).any(axis=1).tolist()
            p = 0
            for k, n, o in zip(part.tolist(), counts, odd, strict=True):
                ids[k] = _final(v, flat[p : p + n]) if o else flat[p : p + n]
                p += n
    for k in np.flatnonzero(size_u > WIDE).tolist():
        ids[k] = _final(v, agenda_heap(v, symbol[start_u[k] : start_u[k] + size_u[k]]))
    corrected = 0
    if check:
        whole = points.tobytes()
        # The library puts the first space mark in front itself.
        names = [whole[4 * a + 4 : 4 * (a + n)].decode("utf-32-le", "surrogatepass") for a, n in zip(start_u.tolist(), size_u.tolist(), strict=True)]
        for i, theirs in enumerate(v.library.encode(names, num_threads=1)):
            if names[i] and theirs != ids[i]:
                ids[i], corrected = theirs, corrected + 1
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for one in ids for x in one), np.int32, int(lengths.sum()))
    n_ids = lengths[which]
    begin = (np.cumsum(lengths) - lengths)[which]
    out_at = np.cumsum(n_ids) - n_ids
    out = flat[np.arange(int(n_ids.sum())) - np.repeat(out_at - begin, n_ids)]
    of = np.searchsorted(ends, start, side="right")
    return out, np.bincount(of, n_ids, len(texts)).astype(np.int64), corrected


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    raw = b"".join([v.bytes[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Per row: id, ids array<int>, decoded string, corrected (of its batch, on the batch's first row)."""

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            for at, texts in chunks(batch.column(1), CHUNK):
                ids, n, wrong = encode_batch(v, texts, check)
                ends = np.cumsum(n)
                flat = ids.tolist()
                decoded = [decode_ids(v, flat[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                corrected = np.zeros(len(texts), np.int64)
                corrected[0] = wrong
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded), pa.array(corrected)], names=["id", "ids", "decoded", "corrected"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>, decoded string, corrected long").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, *keep: str, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ids and decoded texts, beside the columns ``keep``."""
    return encoded.select(
        F.col(id_col),
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
