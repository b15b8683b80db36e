"""Removal of repeated byte strings with suffix arrays.

A string of `length` bytes is repeated if it starts at two places, in one document or two. Both copies
hold the same anchor at the same offset: the k-gram whose hash is least among those of the string
(winnowing). So every start belongs to one anchor, and only starts of equal anchors are compared:

1. Every document's anchors, each with a hash of its context: all strings that have it as their anchor.
2. Contexts that occur twice are repeated as a whole. What is left are equal anchors in different
   contexts. Two of these can share a string only if they share one of STEP bytes less that begins at
   a multiple of STEP before the anchor; contexts that share no such string with another are done.
   Of the others, bytes are fetched, once for each kind.
3. Contexts are dealt into shards by anchor. Each shard builds the suffix array of its contexts
   (Larsson-Sadakane: prefix doubling that touches unsorted groups only) and common prefixes (Kasai's
   walk, in lockstep over the contexts), which gives all repeats within the shard.
4. An anchor with very many contexts is spread over shards. Each of these cuts its sorted strings by
   range; one task per anchor and range merges the shards' strings by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, discard, partitions, sized
from .textbatch import CHUNK, mix, text_bytes

#: Contexts in a shard; an anchor with more of them is spread.
CELL = 1500
#: Bytes between the places before an anchor from which shared strings are looked for.
STEP = 50
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        held = _POWERS[base] = (both[0], both[1])
    return held[0][:n], held[1][:n]


class _Hash:
    """Hashes of any substring of data, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _powers(base, len(data) + 1)
        self.total = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=self.total[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Least key of each window of w, by running minima from both ends of blocks of w."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    front = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], front[w - 1 : n])


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """data, docs, offsets, places, until: slices of about CHUNK bytes. Document docs[i] is data from
    places[i]; of a long one it is the part from offsets[i]. The slice owns the anchors that begin at offset
    until - CHUNK or later and before until; every string that has one of them as its anchor is whole in it."""
    data, bounds = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        if bounds[j] - bounds[i] <= CHUNK:
            yield data[bounds[i] : bounds[j]], np.arange(i, j), np.zeros(j - i, np.int64), bounds[i:j] - bounds[i], CHUNK
        else:
            size = int(bounds[i + 1] - bounds[i])
            for a in range(0, size, CHUNK):
                lo, hi = max(0, a - 2 * length), min(size, a + CHUNK + 2 * length)
                yield data[bounds[i] + lo : bounds[i] + hi], np.array([i]), np.array([lo]), np.array([0]), a + CHUNK
        i = j


def anchors(texts: pa.Array, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, start, size, fp, c1, c2, ends, grid of every anchor: its context is size bytes from start, c1 and c2
    hash it. grid[ends[i] : ends[i + 1]] hash the strings through which context i can share one with another."""
    w, step = length - k + 1, min(STEP, length - k + 1)
    for data, docs, offsets, places, until in pieces(texts, length):
        if len(data) < length:
            continue
        h, g = _Hash(data, _BASES[0]), _Hash(data, _BASES[1])
        at = np.arange(len(data) - k + 1)
        fps = mix(h.of(at, at + k))
        # the last of equal minima: what a window selects depends on its bytes only
        keys = (fps >> _U(24) << _U(24)) | (_U((1 << 24) - 1) - at.astype(_U))
        least = (_U((1 << 24) - 1) - (window_minima(keys, w) & _U((1 << 24) - 1))).astype(np.int64)
        # windows that lie in one document; those of one anchor follow each other
        ends = np.append(places[1:], len(data))
        own = np.repeat(np.arange(len(docs)), ends - places)[: len(least)]
        windows = np.flatnonzero(np.arange(len(least)) + length <= ends[own])
        chosen = least[windows]
        new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]]) if len(chosen) else np.zeros(0, np.int64)
        found, first, last = chosen[new], windows[new], windows[np.r_[new[1:], len(chosen)] - 1]
        of = own[first]
        place = found - places[of] + offsets[of]
        mine = (place < until) & (place >= until - CHUNK) | (len(docs) > 1)
        found, first, last, of = found[mine], first[mine], last[mine], of[mine]
        size = last + length - first
        shape = (found - first).astype(_U) * _U(1 << 20) + size.astype(_U)
        # of a shared string that begins d bytes before the anchor, the part from d // step * step on
        far, near = (found - first) // step, (found - last) // step
        count = far - near + 1
        row = np.repeat(np.arange(len(found)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + near[row]
        from_ = found[row] - number * step
        grid = mix(h.of(from_, np.minimum(from_ + length - step + 1, ends[of][row])) + number.astype(_U)) >> _U(32)
        yield docs[of], first - places[of] + offsets[of], size, fps[found].view(np.int64), mix(h.of(first, first + size) + shape).view(np.int64), mix(g.of(first, first + size) ^ shape).view(np.int64), np.r_[0, np.cumsum(count)], grid.astype(np.uint32).view(np.int32)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first depth bytes at least, and each suffix's group (the place of the
    first suffix that it equals so far). Larsson-Sadakane: the sorted length doubles in each round, and
    only groups with more than one suffix are sorted again."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for i in range(8):
        key = key << _U(8) | padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    h = 8
    while h < depth:
        many = ~(new & np.r_[new[1:], True])  # places of groups that aren't single
        slots = np.flatnonzero(many)
        if not len(slots):
            break
        who = order[slots]
        after = who + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[who].astype(_U) << _U(32) | second.astype(_U)
        by = np.argsort(pair)
        order[slots] = who[by]
        pair = pair[by]
        new[slots] = np.r_[True, pair[1:] != pair[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[slots]] = start[slots]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """For each place in order, how many bytes (cap at most) its suffix shares with the one before.
    order holds the first sizes[t] suffixes of each text t, which starts at starts[t].
    Kasai: one byte to the right, a suffix shares one byte less at least, if the suffix that it was
    compared with has a right neighbour in order too. All texts walk at once."""
    n = len(data)
    place, before = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n + 1, _U)
    for i in range(8):
        key[:n] = key[:n] << _U(8) | padded[i : i + n]
    out, shared, last = np.zeros(len(order), np.int64), np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    stride = np.arange(0, 64, 8)
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > step)
        i = starts[live] + step
        j, have = before[i], np.where((last[live] >= 0) & (place[last[live] + 1] >= 0), np.maximum(shared[live] - 1, 0), 0)
        last[live] = j
        go = np.flatnonzero(j >= 0)
        have[j < 0] = 0
        while len(go):
            a, b = i[go] + have[go], j[go] + have[go]
            room = np.minimum(np.minimum(n - a, n - b), cap - have[go])
            differ = key[np.minimum(a[:, None] + stride, n)] ^ key[np.minimum(b[:, None] + stride, n)]
            first = (differ != 0).argmax(1)
            d = differ[np.arange(len(go)), first]
            lead = np.zeros(len(go), np.int64)
            for bits in (32, 16, 8):
                high = d >> _U(64 - bits) == 0
                lead += high * (bits // 8)
                d = np.where(high, d << _U(bits), d)
            same = np.where(d == 0, 64, 8 * first + lead)
            gain = np.minimum(same, np.maximum(room, 0))
            have[go] += gain
            go = go[(gain == 64) & (have[go] < cap)]
        shared[live] = have
        out[place[i]] = have
    return out


def repeats_in(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts with length bytes after them: text, start, and class (equal strings are one class),
    sorted by class; data holds the texts one after another."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.r_[0, sizes[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    order, _ = suffix_array(data, len(data))  # in full: the walk relies on it
    whole = np.repeat(sizes - length + 1, sizes) > np.arange(len(data)) - np.repeat(starts, sizes)
    order = order[whole[order]]
    shared = common_prefixes(data, order, starts, np.maximum(sizes - length + 1, 0), length)
    text = np.searchsorted(starts, order, "right") - 1
    return text, order - starts[text], np.cumsum(shared < length), data


_SPAN = "doc_id long, th long, lo long, hi long"
_PLACE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc_id", "<i8"), ("th", "<i8"), ("at", "<i8"), ("known", "<i8")])


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, lo, hi: unions of [start, start + length) for sorted (doc, start)."""
    if not len(doc):
        return doc, start, start
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], start[new], start[last] + length


def _shard_repeats(length: int, ranges: int):
    schema = f"{_SPAN}, anchor long, range int, packed binary"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame["context"].tolist()
        text, start, kind, data = repeats_in(texts, length)
        twice = np.bincount(kind, minlength=1)[kind] > 1  # every start is of one context: a class of two repeats
        at = frame["at"].to_numpy(np.int64)
        hit = np.lexsort((start[twice], text[twice]))
        d, lo, hi = _runs(text[twice][hit], start[twice][hit], length)
        ids, th = frame["doc_id"].to_numpy(np.int64), frame["th"].to_numpy(np.int64)
        out = pd.DataFrame({"doc_id": ids[d], "th": th[d], "lo": lo + at[d], "hi": hi + at[d], "anchor": None, "range": None, "packed": None})
        if len(texts) and frame["spread"].iloc[0]:  # a row for each range of the sorted strings, for the search across shards
            g = np.cumsum(np.r_[0, [len(t) for t in texts]])[:-1][text] + start
            places = np.empty(len(g), _PLACE)
            places["h1"], places["h2"] = (mix(_Hash(data, b).of(g, g + length)) for b in _BASES)
            places["doc_id"], places["th"], places["at"], places["known"] = ids[text], th[text], at[text] + start, twice
            places = places[np.lexsort((places["h2"], places["h1"]))]
            edges = np.searchsorted(places["h1"], (np.arange(1, ranges, dtype=_U) * _U((1 << 64) // ranges)))
            rows = [(r, part.tobytes()) for r, part in enumerate(np.split(places, edges)) if len(part)]
            more = pd.DataFrame({"doc_id": None, "th": None, "lo": None, "hi": None, "anchor": key[0], "range": [r for r, _ in rows], "packed": [p for _, p in rows]})
            out = pd.concat([out.astype(object), more.astype(object)])
        return out

    return run, schema


def merge_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted tables of places as one, by bisection of one's keys in the other."""
    out = np.empty(len(a) + len(b), a.dtype)
    into = np.searchsorted(a["h1"], b["h1"], "right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[into] = False
    out[into], out[rest] = b, a
    return out


def _across(length: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tables = [np.frombuffer(p, _PLACE) for p in frame["packed"]]
        while len(tables) > 1:
            tables = [merge_sorted(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
        all_ = tables[0]
        new = np.r_[True, all_["h1"][1:] != all_["h1"][:-1]]
        all_ = all_[np.lexsort((all_["h2"], np.cumsum(new)))] if not new.all() else all_  # the second hash orders equal first ones
        new = np.r_[True, (all_["h1"][1:] != all_["h1"][:-1]) | (all_["h2"][1:] != all_["h2"][:-1])]
        kind = np.cumsum(new) - 1
        hit = all_[(np.bincount(kind)[kind] > 1) & (all_["known"] == 0)]
        return pd.DataFrame({"doc_id": hit["doc_id"], "th": hit["th"], "lo": hit["at"], "hi": hit["at"] + length})

    return run


def repeated_spans(docs: DataFrame, length: int = 400, k: int = 100) -> DataFrame:
    """doc_id, th, lo, hi: byte ranges of docs (doc_id, text, th = a hash of the text) that repeated
    strings of length bytes cover; ranges may overlap. A null doc_id comes back as the least bigint."""
    spark = docs.sparkSession
    schema = "doc_id long, th long, pos long, size int, fp long, c1 long, c2 long, grid array<int>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for from_ in range(0, whole.num_rows, 1024):
                batch = whole.slice(from_, 1024)
                ids, th = batch.column(0), batch.column(2)
                for doc, start, size, fp, c1, c2, ends, grid in anchors(batch.column(1), length, k):
                    own = pa.array(doc)
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(grid))
                    yield pa.record_batch([ids.take(own), th.take(own), pa.array(start), pa.array(size.astype(np.int32)), pa.array(fp), pa.array(c1), pa.array(c2), lists], ["doc_id", "th", "pos", "size", "fp", "c1", "c2", "grid"])

    least = F.lit(-(1 << 63))
    named = docs.select(F.coalesce("doc_id", least).alias("doc_id"), "text", "th")
    found = cut(named.where(F.octet_length("text") >= length).mapInArrow(find, schema))

    # contexts that occur more than once are repeated as a whole
    kinds = cut(found.groupBy("fp", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "size", "grid")).alias("one")))
    twice = found.join(kinds.where("n > 1").select("fp", "c1", "c2").hint("merge"), ["fp", "c1", "c2"])
    spans = cut(twice.select("doc_id", "th", F.col("pos").alias("lo"), (F.col("pos") + F.col("size")).alias("hi")))
    discard(found)

    # anchors in different contexts that may share a string: one context of each kind is compared with the others
    several = kinds.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1")
    some = cut(kinds.join(several.hint("merge"), "fp").select("fp", "c1", "c2", "one"))
    discard(kinds)
    probes = some.select("fp", "c1", "c2", F.explode("one.grid").alias("part"))
    shared = probes.groupBy("fp", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alike = probes.join(shared.hint("merge"), ["fp", "part"]).select("fp", "c1", "c2").distinct()
    todo = cut(some.join(alike.hint("merge"), ["fp", "c1", "c2"]).select("fp", "c1", "c2", "one.doc_id", "one.th", "one.pos", "one.size"))
    n = todo.count()
    discard(some)
    if n == 0:
        return spans
    todo = todo.join(todo.groupBy("fp").agg(F.count("*").alias("kinds")).hint("merge"), "fp")
    buckets = max(1, -(-n // CELL))
    spread = F.col("kinds") > CELL
    # a spread anchor has buckets of its own: those of its hash
    bucket = F.when(spread, F.xxhash64("fp")).otherwise(F.pmod(F.xxhash64("fp"), F.lit(buckets)))
    salt = F.when(spread, F.pmod(F.xxhash64("c1", "c2"), F.ceil(F.col("kinds") / CELL)) + 1).otherwise(0).cast("long")
    todo = todo.select("doc_id", "th", "pos", "size", bucket.alias("bucket"), spread.alias("spread"), salt.alias("salt"))
    wanted = cut(todo.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "size", "bucket", "salt", "spread")).alias("wanted")))
    ids = wanted.select("doc_id", "th").withColumnsRenamed({"doc_id": "i", "th": "t"})
    same = (F.col("doc_id") == F.col("i")) & (F.col("th") == F.col("t"))
    holders = named.join(sized(ids), same, "left_semi")
    holders = holders.dropDuplicates(["doc_id", "th"]).join(wanted.hint("shuffle_hash"), ["doc_id", "th"])
    contexts = holders.select("doc_id", "th", F.to_binary("text", F.lit("utf-8")).alias("b"), F.explode("wanted").alias("w"))
    contexts = contexts.select("doc_id", "th", "w.bucket", "w.salt", "w.spread", F.col("w.pos").alias("at"), F.expr("substring(b, cast(w.pos as int) + 1, w.size)").alias("context"))
    run, schema = _shard_repeats(length, partitions(spark))
    sorted_ = cut(contexts.groupBy("bucket", "salt").applyInPandas(run, schema))
    across = sorted_.where("range is not null").groupBy("anchor", "range").applyInPandas(_across(length), _SPAN)
    return spans.unionByName(sorted_.where("range is null").select("doc_id", "th", "lo", "hi")).unionByName(across)


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 100) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Texts are their UTF-8 bytes, a null one empty. Every byte that a string of length bytes covers
    which also starts elsewhere, in this or another row, is removed; strings overlap freely and are
    judged on the input. Rows that repeat are two documents, so all their strings repeat. Shorter texts
    stay whole. An empty table gives an empty result; other columns are ignored."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(base, length, k).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = cut(spans).withColumnsRenamed({"doc_id": "i", "th": "t"})
    least = F.lit(-(1 << 63))
    same = (F.coalesce("doc_id", least) == F.col("i")) & (F.col("th") == F.col("t"))
    joined = base.join(spans.hint("shuffle_hash"), same, "left").select("doc_id", "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for from_ in range(0, whole.num_rows, 1024):
                batch = whole.slice(from_, 1024)
                data, bounds = text_bytes(batch.column(1))
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for a, b, lo, hi in zip(bounds[:-1], bounds[1:], batch.column(2), batch.column(3)):
                    own, runs = data[a:b], []
                    if lo.is_valid:
                        s, e = np.array(lo.as_py(), np.int64), np.array(hi.as_py(), np.int64)
                        order = np.argsort(s, kind="stable")
                        s, e = s[order], np.maximum.accumulate(e[order])
                        new = np.r_[True, s[1:] > e[:-1]]
                        runs = list(zip(s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]))
                    keep = np.ones(len(own), bool)
                    for s, e in runs:
                        keep[s:e] = False
                    out["n_bytes"].append(len(own))
                    out["n_removed"].append(int(len(own) - keep.sum()))
                    out["n_spans"].append(len(runs))
                    out["kept"].append(own[keep].tobytes() if runs else own.tobytes())
                yield pa.record_batch([batch.column(0), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept"], pa.binary())], ["doc_id", *out])

    return joined.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
