"""Vectorised text kernels used inside Arrow batches.

A batch of texts becomes one array of code points; words and character n-grams
are found and hashed by whole-array arithmetic, so the cost per character is a
few nanoseconds and no Python loop runs over characters or words. Texts are
always processed whole. ``None`` counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Characters per numpy pass; a longer text is a pass of its own.
PASS_CHARS = 250_000
_LIMIT = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_cache: dict[str, Any] = {}


def tidy() -> None:
    """Give freed memory back to the system: a Python worker is used again for other tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if "libc" not in _cache:
        try:
            _cache["libc"] = ctypes.CDLL("libc.so.6")
        except OSError:
            _cache["libc"] = None
    if _cache["libc"] is not None and hasattr(_cache["libc"], "malloc_trim"):
        _cache["libc"].malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _table(name: str) -> np.ndarray:
    if name not in _cache:
        if name == "values":
            _cache[name] = mix(np.arange(1, _LIMIT + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        else:
            test = {"alnum": str.isalnum, "alpha": str.isalpha, "space": str.isspace}[name]
            _cache[name] = np.fromiter((test(chr(i)) for i in range(_LIMIT)), np.bool_, _LIMIT)
    return _cache[name]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _cache or len(_cache["powers"]) < n:
        size = max(n, 1 << 18)
        for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _cache[name] = np.cumprod(p, dtype=np.uint64)
    return _cache["powers"], _cache["inverse"]


def passes(texts: list[str | None], chars: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of the list that hold about ``chars`` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed; where each begins, and the end."""
    parts = [(t.lower() if lower else t) if t else "" for t in texts]
    c = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)), out=offs[1:])
    return c, offs


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true flags."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def span_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; equal spans have equal hashes wherever they stand."""
    power, inverse = _powers(len(c))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(_table("values")[c] * power[: len(c)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts: list[str | None], lower: bool = True, kind: str = "alnum") -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (maximal run of letters and digits) in order; and where each text's words begin, and the end."""
    c, offs = codes(texts, lower)
    flags = ~_table("space")[c] if kind == "space" else _table(kind)[c]
    starts, ends = runs(flags)
    return span_hashes(c, starts, ends), np.searchsorted(starts, offs)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to this one word."""
    return int(words([word], kind="space")[0][0])


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of the values of each segment; an empty one has 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def char_grams(texts: list[str | None], sizes: tuple[int, ...], dims: int, letters: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket of every character n-gram, and where each text's begin, and the end.

    ``letters``: lower case, and each run of other characters is one space; a space stands at both ends.
    """
    c, offs = codes(texts, lower=letters)
    if letters:
        alpha = _table("alpha")[c]
        keep = alpha.copy()
        keep[1:] |= alpha[:-1]
        c, offs = np.where(alpha, c, np.uint32(32))[keep], np.concatenate(([0], np.cumsum(keep)))[offs]
        c = np.concatenate((np.array([32], np.uint32), c))  # the space before the first text; the others follow a space
    out = []
    for n in sizes:
        m = len(c) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(offs), np.int64)))
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ c[j : m + j]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        buckets = (h & np.uint32(dims - 1)).astype(np.int64)
        if letters:  # an n-gram belongs to the text in which it begins (or whose leading space it begins with)
            doc_of, inside = np.repeat(np.arange(len(offs) - 1), np.diff(offs)), None
            first = doc_of[: min(m, len(doc_of))]
            last = doc_of[np.minimum(np.arange(len(first)) + max(0, n - 2), len(doc_of) - 1)]
            inside = first == last
            buckets = buckets[: len(first)][inside]
            out.append((buckets, np.searchsorted(first[inside], np.arange(len(offs)))))
        else:
            begins = offs[:-1]
            lens = np.maximum(np.diff(offs) - 1 - n + 1, 0)
            where = np.zeros(len(offs), np.int64)
            np.cumsum(lens, out=where[1:])
            idx = np.arange(where[-1]) - np.repeat(where[:-1] - begins, lens)
            out.append((buckets[idx], where))
    return out


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    """Another family of hashes made of the first."""
    return mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def word_features(texts: list[str | None], prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and of the longer words' prefixes, and the number of the text that each stands in."""
    c, offs = codes(texts)
    starts, ends = runs(_table("alnum")[c])
    doc = np.searchsorted(offs, starts, side="right") - 1
    hashes, docs = [span_hashes(c, starts, ends)], [doc]
    for n in prefixes:
        longer = np.flatnonzero(ends - starts > n)
        hashes.append(salted(span_hashes(c, starts[longer], starts[longer] + n), n))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)
