"""Vectorised numpy over the bytes of an Arrow batch of texts: words, hashes and counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are cut at white space.
CHUNK = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@lru_cache(maxsize=1)
def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers_upto(1 << max(19, (n - 1).bit_length()))
    return up[:n], down[:n]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, and of about most bytes: what numpy makes of a slice's words is many
    times its text."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while most and n > 1 and batch.slice(at, n).nbytes > most:
                n = -(-n // 2)
            yield batch.slice(at, n)
            at += n


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and each text's bounds; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """data, bounds, docs: pieces of about limit bytes. Text docs[i] (or a part of it, cut before white
    space) is data[bounds[i] : bounds[i + 1]]."""
    if not len(texts):
        return
    data, bounds = text_bytes(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        if bounds[j] - bounds[i] <= limit:
            yield data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], np.arange(i, j)
        else:  # one long text
            at, end = int(bounds[i]), int(bounds[i + 1])
            while at < end:
                to = min(end, at + limit)
                while to < end:
                    gap = np.flatnonzero(IS_SPACE[data[to : to + 4096]])
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(end, to + 4096)
                yield data[at:to], np.array([0, to - at]), np.array([i])
                at = to
        i = j


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, doc, length of every word (a run without ASCII white space, A-Z lower-cased), in order."""
    hashes, owners, lengths = [], [], []
    for data, bounds, docs in chunks(texts):
        low, blank = LOWER[data], IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds[:-1]] = edge[bounds[1:]] = True
        before = np.empty(len(data), bool)
        if not len(data):
            continue
        before[0] = True
        before[1:] = blank[:-1]
        starts = np.flatnonzero(~blank & (before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1] = True
        after[:-1] = blank[1:]
        ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((low.astype(_U) + _U(1)) * up[:-1], out=total[1:])
        size = ends - starts
        hashes.append(mix((total[ends] - total[starts]) * down[starts] + size.astype(_U) * _U(0xD6E8FEB86659FD93)))
        owners.append(docs[np.searchsorted(bounds, starts, "right") - 1])
        lengths.append(size)
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(lengths)


def shingles(hashes: np.ndarray, owners: np.ndarray, n_docs: int, n: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its runs of n words; with fewer words, the whole
    sequence as one; without words, none."""
    counts = np.bincount(owners, minlength=n_docs)
    ends = np.cumsum(counts)
    rolled = mix(hashes + _U(n))
    for k in range(1, n):
        rolled[: len(hashes) - k] = mix(rolled[: len(hashes) - k] * _U(0xFF51AFD7ED558CCD) + hashes[k:]) if len(hashes) > k else rolled[: len(hashes) - k]
    out = []
    for end, count in zip(ends, counts):
        if count >= n:
            own = np.sort(rolled[end - count : end - n + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
        elif count:
            few = mix(np.array([count], _U))
            for h in hashes[end - count : end]:
                few = mix(few * _U(0xC4CEB9FE1A85EC53) + h)
            out.append(few)
        else:
            out.append(np.zeros(0, _U))
    return out
