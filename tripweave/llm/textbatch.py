"""Words, lines and shingles of many texts at once, as numpy arrays.

Texts are laid end to end as UTF-8 with a newline after each, so every count
is a difference of running sums, and every word or line hash a difference of
running polynomial sums modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporaries at about 50 MB.
CHUNK_BYTES = 1_000_000
#: Texts handled at once: fewer than 65,536, so that a text's number fits beside a shingle.
CHUNK_ROWS = 16_384
SLICE_ROWS = 256

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 70_000), base, U)
        have[0] = U(1)
        with np.errstate(over="ignore"):
            _powers[int(base)] = have = np.cumprod(have, dtype=U)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def chunks(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) with nulls as empty, of about ``most`` (CHUNK_BYTES) characters and at most CHUNK_ROWS texts each."""
    most = most or CHUNK_BYTES
    at, held, out = 0, 0, []
    for begin in range(0, len(texts), SLICE_ROWS):
        for t in texts.slice(begin, SLICE_ROWS).to_pylist():
            out.append(t or "")
            held += len(t) if t else 1
            if held >= most or len(out) >= CHUNK_ROWS:
                yield at, out
                at, held, out = at + len(out), 0, []
    if out:
        yield at, out
    give_back()


def give_back() -> None:
    """Hands freed memory back: workers outlive their task and sit idle beside the next ones."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class TextBatch:
    """Texts as one byte array; ``from_`` and ``to`` bound each text."""

    def __init__(self, texts: list[str], fold: np.ndarray | None = None):
        """``fold`` maps bytes to bytes first (newlines between texts must stay white space)."""
        self.n = len(texts)
        raw = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
        self.data = np.frombuffer(raw, np.uint8)
        if fold is not None:
            self.data = fold[self.data]
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, self.n)
        self.to = np.cumsum(sizes + 1) - 1
        self.from_ = self.to - sizes
        space = IS_SPACE[self.data]
        self.in_word = ~space
        edge = np.flatnonzero(np.diff(self.in_word.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[0::2], edge[1::2]
        #: Of each text: its first word; one more entry at the end.
        self.first = np.append(np.searchsorted(self.start, self.from_), len(self.start))
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        with np.errstate(over="ignore"):
            self._sum = np.concatenate([[U(0)], np.cumsum(_BYTE[self.data] * powers(BASE, len(self.data)), dtype=U)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span."""
        with np.errstate(over="ignore"):
            return mix64((self._sum[end] - self._sum[start]) * powers(INVERSE, len(self.data) + 1)[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))

    def words(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def count(self, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many bytes of each span are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[end] - total[start]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``k`` words within a text."""
        w = self.words()
        n = len(w) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        with np.errstate(over="ignore"):
            h = w[:n].copy()
            for j in range(1, k):
                h = h * BASE + w[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix64(h[at])


def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item whether its hash occurs again in the same text."""
    with np.errstate(over="ignore"):
        key = mix64(h + doc.astype(U) * U(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def shingle_sets(batch: TextBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle, occurrences), each shingle of a text once, in order.

    A text of fewer than ``k`` words, but at least one, has one shingle of all its words.
    """
    if batch.n > 65_536:
        raise ValueError("a batch of more than 65,536 texts: take chunks")
    at, h = batch.windows(k)
    doc = batch.doc[at]
    short = np.flatnonzero((batch.n_words > 0) & (batch.n_words < k))
    if len(short):
        w = batch.words()
        with np.errstate(over="ignore"):
            own = np.array([_fold(w[batch.first[d] : batch.first[d + 1]]) for d in short], U)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix64(own)])
    key = np.sort((doc.astype(U) << U(48)) | (h >> U(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U(0xFFFFFFFFFFFF), times


def _fold(words: np.ndarray) -> np.uint64:
    out = int(len(words)) + 77
    for w in words:
        out = (out * int(BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF
    return U(out)
