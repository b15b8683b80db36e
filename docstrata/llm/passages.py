"""Removal of passages that repeat across documents, found through difference-cover anchors.

A window is `length` consecutive words of a document. Its words are removed where the same words also start in
a document with a smaller doc_id. Windows aren't hashed at every place:

1. Of equal texts, the one with the smallest doc_id stands for all: it holds each of their windows first.
2. Places whose number modulo PERIOD lies in COVER get an anchor, a hash of the length - PERIOD + 1 words from
   there. COVER is a difference cover: each difference modulo PERIOD is one of two of its members. So of two equal
   windows, wherever they start, some place less than PERIOD words on has an anchor in both, and it is equal.
3. Anchors that two documents share are extended: only the windows around them are hashed (96 bits) and meet, to
   find the smallest doc_id of each.
4. Windows that start in a smaller document give the words to remove.

Anchors and windows meet by ranges of their hashes: a task packs those of its documents by range, in numpy arrays, and one
task sorts each range and answers for the places that it holds. What a slice of documents shares among itself it settles
itself and sends once, so a passage of very many documents is a row for each slice of them, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, partitions, release, sized
from .textbatch import CHUNK, IS_SPACE, mix, small_batches, text_bytes

PERIOD = 7
COVER = (1, 2, 4)
assert {(a - b) % PERIOD for a, b in product(COVER, COVER)} == set(range(PERIOD))

#: Ranges of hashes at least; with many shuffle partitions, half as many as these.
RANGES = 32

#: Bytes of documents whose anchors or windows a task holds at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 23

#: A null doc_id counts as larger than all others.
LAST = (1 << 63) - 1
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, CHUNK + 1), b, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        held = _POWERS[base] = (both[0], both[1])
    return held[0][:n], held[1][:n]


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the first byte of every word of data; no word crosses an edge."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
    blank = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]]))
    ends = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True])) + 1
    out = []
    for base in _BASES:
        up, down = _powers(base, len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))
    return out[0], out[1], starts


def parts(texts: pa.Array, carry: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """h1, h2, doc, number of the words of texts, in parts of about CHUNK bytes. Of a long text a part repeats the
    last carry words of the part before, so that all runs of carry + 1 words are whole in one."""
    data, bounds = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        if bounds[j] - bounds[i] <= CHUNK:
            own = bounds[i : j + 1] - bounds[i]
            h1, h2, starts = word_hashes(data[bounds[i] : bounds[j]], own)
            doc = np.searchsorted(own, starts, "right") - 1
            counts = np.bincount(doc, minlength=j - i)
            yield h1, h2, doc + i, np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        else:
            at, end, seen = int(bounds[i]), int(bounds[i + 1]), 0
            before = np.zeros((2, 0), _U)
            while at < end:
                to = min(end, at + CHUNK)
                while to < end and not IS_SPACE[data[to]]:
                    gap = np.flatnonzero(IS_SPACE[data[to : min(end, to + 4096)]])
                    to = to + int(gap[0]) if len(gap) else min(end, to + 4096)
                h1, h2, _ = word_hashes(data[at:to], np.array([0, to - at]))
                both = np.concatenate([before, np.stack([h1, h2])], axis=1)
                yield both[0], both[1], np.full(both.shape[1], i), seen - before.shape[1] + np.arange(both.shape[1])
                seen += len(h1)
                before = both[:, max(0, both.shape[1] - carry) :]
                at = to
        i = j


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = mix(h[: len(h) - n + 1] + _U(n))
    for k in range(1, n):
        out = mix(out * _U(0xFF51AFD7ED558CCD) + h[k : len(h) - n + 1 + k])
    return out


def anchors(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc, word number, hash of every anchor that lies whole in its text."""
    n = length - PERIOD + 1
    for h1, _, doc, number in parts(texts, n - 1):
        if len(h1) < n:
            continue
        at = np.flatnonzero(np.isin(number[: len(h1) - n + 1] % PERIOD, COVER) & (doc[: len(h1) - n + 1] == doc[n - 1 :]))
        yield doc[at], number[at], rolled(h1, n)[at]


def windows(texts: pa.Array, shared: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, first word, h1, h2 of the windows of texts that hold a shared anchor of theirs (by word number)."""
    n = length - PERIOD + 1
    for h1, h2, doc, number in parts(texts, length - 1):
        if len(h1) < length:
            continue
        last = len(h1) - length + 1
        whole = doc[:last] == doc[length - 1 :]
        # how many shared anchors there are before each word, for the words of this part
        hit = np.zeros(len(h1) + 1, np.int64)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)]):
            places = shared[doc[a]] - number[a]
            hit[a + 1 + places[(places >= 0) & (places < b - a)]] = 1
        hit = np.cumsum(hit)
        at = np.flatnonzero(whole & (hit[PERIOD : PERIOD + last] > hit[:last]))
        yield doc[at], number[at], rolled(h1, length)[at], rolled(h2, length)[at]


#: A piece: the keys of one range, their document (a place in ids and ths) and word; or what a slice settled itself.
_PIECE = "range int, k1 binary, k2 binary, doc binary, at binary, ids binary, ths binary, doc_id long, th long, places array<int>"
_PLACES = "doc_id long, th long, places array<int>"
#: Stands for two documents of a slice that have an anchor in common.
_SEVERAL = np.uint16(65535)


def _listed(ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """doc_id, th and the places at of each document in doc (numbers in ids and ths)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)].astype(np.int32)), pa.array(at.astype(np.int32)))
    return ids[doc[new]], ths[doc[new]], lists


def _packed(ids: np.ndarray, ths: np.ndarray, k1: np.ndarray, k2: np.ndarray | None, doc: np.ndarray, at: np.ndarray, own: tuple[np.ndarray, np.ndarray], ranges: int) -> pa.RecordBatch:
    """The pieces of a slice of documents: keys by range (the first hash modulo ranges), and the places own (doc, at) that
    are settled, for the ranges below zero that pass them on."""
    part = (k1 % _U(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(ranges + 1))
    rows: dict[str, list] = {name: [] for name in ("range", "k1", "k2", "doc", "at", "ids", "ths")}
    for r in np.flatnonzero(np.diff(edges)).tolist():
        mine = order[edges[r] : edges[r + 1]]
        held, number = np.unique(np.minimum(doc[mine], len(ids)), return_inverse=True)
        number = np.where(doc[mine] == _SEVERAL, _SEVERAL, number).astype(np.uint16)
        held = held[held < len(ids)]
        for name, x in (("k1", k1[mine] if k2 is not None else (k1[mine] >> _U(32)).astype(np.uint32)), ("k2", None if k2 is None else k2[mine]), ("doc", number), ("at", at[mine].astype(np.int32)), ("ids", ids[held]), ("ths", ths[held])):
            rows[name].append(None if x is None else x.tobytes())
        rows["range"].append(r)
    doc_ids, doc_ths, lists = _listed(ids, ths, *own)
    n, m = len(rows["range"]), len(doc_ids)
    passed = -1 - np.arange(m) % ranges
    nulls = pa.nulls(m, pa.binary())
    columns = [pa.array(rows["range"] + passed.tolist(), pa.int32()), *[pa.concat_arrays([pa.array(rows[c], pa.binary()), nulls]) for c in ("k1", "k2", "doc", "at", "ids", "ths")]]
    columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in (doc_ids, doc_ths)] + [pa.concat_arrays([pa.nulls(n, lists.type), lists])]
    return pa.record_batch(columns, [c.split()[0] for c in _PIECE.split(", ")])


def _answer(chosen: Callable[..., np.ndarray], width: type):
    """The task of one range: chosen(k1, k2, document, its doc_id) says which entries are answered."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("range")[0].as_py() < 0:
            return table.select(["doc_id", "th", "places"])
        read = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)] if table.num_rows else [np.zeros(0, kind)]
        ids, ths, doc = read("ids", np.int64), read("ths", np.int64), read("doc", np.uint16)
        base = np.cumsum([0, *map(len, ids)])
        # documents that stand for several get numbers of their own, below zero
        doc = np.concatenate([np.where(d == _SEVERAL, -1 - i, d + base[i]) for i, d in enumerate(doc)])
        k1, at, ids, ths = np.concatenate(read("k1", width)), np.concatenate(read("at", np.int32)), np.concatenate(ids), np.concatenate(ths)
        k2 = np.concatenate(read("k2", np.uint32)) if table.column("k2").null_count == 0 else None
        hit = chosen(k1, k2, doc, ids)
        a, b, lists = _listed(ids, ths, doc[hit], at[hit])
        return pa.table({"doc_id": pa.array(a, pa.int64()), "th": pa.array(b, pa.int64()), "places": lists})

    return run


def _shared(k1: np.ndarray, k2: np.ndarray | None, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries whose key several documents have."""
    if not len(k1):
        return np.zeros(0, np.int64)
    order = np.argsort(k1, kind="stable")
    new = np.flatnonzero(np.r_[True, k1[order][1:] != k1[order][:-1]])
    own = doc[order]
    several = (np.minimum.reduceat(own, new) != np.maximum.reduceat(own, new)) | (np.minimum.reduceat(own, new) < 0)
    hit = order[np.repeat(several, np.diff(np.r_[new, len(order)]))]
    return hit[doc[hit] >= 0]


def _after_the_first(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries whose key a document with a smaller doc_id has."""
    if not len(k1):
        return np.zeros(0, np.int64)
    order = np.lexsort((k2, k1))
    a, b, own = k1[order], k2[order], ids[doc[order]]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.r_[new, len(order)]))
    return order[own > least]


def _joined(found: Iterator[tuple[np.ndarray, ...]], kinds: tuple) -> list[np.ndarray]:
    parts_ = list(zip(*found)) or [()] * len(kinds)
    return [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in zip(parts_, kinds)]


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, th, places: word numbers at which a window of docs (doc_id, th, text; texts distinct) starts whose
    words also start in a document with a smaller doc_id. A document may have several rows."""
    ranges = max(RANGES, partitions(docs.sparkSession) // 2)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=SLICE_BYTES):
            ids, ths = (batch.column(i).to_numpy() for i in (0, 1))
            doc, at, h = _joined(anchors(batch.column(2), length), (np.int64, np.int64, _U))
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
            own = doc[order]
            several = np.minimum.reduceat(own, new) != np.maximum.reduceat(own, new) if len(h) else np.zeros(0, bool)
            inside = np.repeat(several, np.diff(np.r_[new, len(h)]))
            settled, once, alone = order[inside], order[new[several]], order[~inside]
            sent = np.r_[alone, once]
            yield _packed(ids, ths, h[sent], None, np.r_[doc[alone], np.full(len(once), int(_SEVERAL))], at[sent], (doc[settled], at[settled]), ranges)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=SLICE_BYTES):
            ids, ths = (batch.column(i).to_numpy() for i in (0, 1))
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            places = [values[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:])]
            doc, at, k1, k2 = _joined(windows(batch.column(2), places, length), (np.int64, np.int64, _U, _U))
            k2 = (k2 >> _U(32)).astype(np.uint32)
            later = _after_the_first(k1, k2, doc, ids)
            sent = np.ones(len(doc), bool)
            sent[later] = False
            yield _packed(ids, ths, k1[sent], k2[sent], doc[sent], at[sent], (doc[later], at[later]), ranges)

    def meet(packed: DataFrame, run) -> DataFrame:
        return packed.groupBy("range").applyInArrow(run, _PLACES)

    shared = meet(docs.mapInArrow(find, _PIECE), _answer(_shared, np.uint32))
    places = cut(shared.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("places")).alias("places")))
    release(docs.sparkSession)
    holders = docs.join(places.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "places")
    found = cut(meet(holders.mapInArrow(extend, _PIECE), _answer(_after_the_first, _U)))
    release(docs.sparkSession)
    return found


def _kept(text: bytes, gone: np.ndarray) -> tuple[int, int, list[bytes]]:
    """Words, words removed and the runs of kept words of a text; gone: first and last word (exclusive) of each run."""
    count, removed, out, at = 0, 0, [], 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and not text[to : to + 1].isspace():
            to += 1
        words = text[at:to].split()  # of bytes, at ASCII white space
        if len(gone):
            i = np.arange(count, count + len(words))
            k = np.searchsorted(gone[:, 0], i, "right") - 1
            out_of = (k >= 0) & (i < gone[k, 1])
            removed += int(out_of.sum())
            count += len(words)
            words = [w for w, g in zip(words, out_of.tolist()) if not g]
        else:
            count += len(words)
        if words:
            out.append(b" ".join(words))
        at = to
    return count, removed, out


def remove_passages(docs: DataFrame, length: int = 13) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and kept (the words that are
    left, joined by one space, binary).

    Words are runs without ASCII white space, unchanged; a null text has none. Every word that a window of length words
    covers which also starts in a row with a smaller doc_id is removed; windows overlap freely and are judged on the
    input. Rows that repeat a doc_id aren't smaller than each other, so all of them keep what a smaller one doesn't
    hold; a null doc_id is larger than all others. Texts of fewer words stay whole, an empty table gives an empty result;
    other columns are ignored. length is PERIOD words at least."""
    if length < PERIOD:
        raise ValueError(f"length is {PERIOD} words at least")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("th", F.xxhash64("text")).withColumn("sha", F.sha2("text", 256))
    # the smallest doc_id of each text; rows of other doc_ids hold nothing that it doesn't hold before them
    copies = base.where(F.octet_length("text") >= 2 * length - 1).groupBy("sha").agg(F.min("id").alias("one"), F.max("id").alias("most"))
    copies = cut(copies.where("one < most").select("sha", "one"))
    known = base.join(sized(copies), "sha", "left").withColumn("copy", F.coalesce(F.col("one") < F.col("id"), F.lit(False)))
    single = known.where((F.octet_length("text") >= 2 * length - 1) & ~F.col("copy")).select(F.col("id").alias("doc_id"), "th", "text")
    # rows that repeat id and text are looked for by their hashes: only if there are some, texts are shuffled to drop them
    if not base.groupBy("id", "th").count().where("count > 1").isEmpty():
        single = single.dropDuplicates(["doc_id", "th"])
    spans = repeated_windows(single, length).groupBy("doc_id", "th").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("firsts"))
    spans = cut(spans).withColumnsRenamed({"doc_id": "i", "th": "t"})
    joined = known.join(spans.hint("shuffle_hash"), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "copy", "firsts")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=SLICE_BYTES):
            data, bounds = text_bytes(batch.column(1))
            rows = []
            for a, b, copy, firsts in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(2).to_pylist(), batch.column(3)):
                gone = np.zeros((0, 2), np.int64)
                if firsts.is_valid:
                    s = firsts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    new = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + length])
                    gone = np.column_stack([s[new], s[np.r_[new[1:], len(s)] - 1] + length])
                n, removed, kept = _kept(data[a:b].tobytes(), gone)
                if copy and n >= length:
                    removed, kept = n, []
                whole = b" ".join(kept)
                rows.append((n, removed, hashlib.sha256(whole).hexdigest(), whole))
            n, removed, sha, kept = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
    f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM p JOIN f USING (s) WHERE least < doc_id),
    one AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    k AS (SELECT o.r, count(g.i) AS n, string_agg(word, ' ' ORDER BY o.i) FILTER (g.i IS NULL) AS kept FROM one o LEFT JOIN gone g ON g.r = o.r AND g.i = o.i GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
