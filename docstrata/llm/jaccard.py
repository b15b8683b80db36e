"""N-gram Jaccard join of documents by grouped prefixes.

1. A document becomes the set of its distinct word n-gram hashes; equal sets are one class.
2. Range by range of hashes, n-grams are counted over all classes. An n-gram that only one set has can't be
   shared, so the global order is: rarest first. Two sets that reach the threshold share an n-gram in their
   prefixes; a set whose prefix holds n-grams of its own only is done. Of the other prefixes, the shared part
   is kept. Classes with identical prefixes and size form one group.
3. Every class is verified against its group's first member, every group against the first group of a bucket
   (the groups that share a prefix n-gram): verified pairs make components.
4. Then, exactly, the groups of a bucket that lie in different components are filtered by size, place and
   outlines of their whole sets while they are met; the group pairs left are expanded and their members
   verified. Pairs within a component need no look, so near copies in great numbers cost no square.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, discard, sized
from .components import connected_components, extend_components
from .textbatch import mix, shingles, small_batches, words

#: n-grams of one range of hashes, which one task counts, and n-grams held before they are dealt to ranges.
RANGE_GRAMS = 1 << 21
HELD_GRAMS = 1 << 19
#: Counters of the sketch that finds n-grams of a share of all that is too large for a range: one in this many.
SKETCH_BITS = 18
SKETCH_SHARDS = 16
HOT_SHARE = 4096
#: Groups of a bucket that meet in one block, and pairs that a task holds at once.
BLOCK = 4096
PAIRS = 1 << 16
#: 64-bit words of the outline of a set that a bucket's entries carry.
OUTLINE = 32
#: n-grams before its own place that an entry of a bucket names, so that a pair isn't made again.
EARLIER = 4
_U = np.uint64

#: A set's n-grams in one range: two hashes and the size of the whole set, and how many n-grams follow.
_RUN = np.dtype([("h", "<u8"), ("g", "<u4"), ("n", "<u4"), ("k", "<u4")])


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    hashes, owners, _ = words(batch.column(1))
    return shingles(hashes, owners, batch.num_rows, n)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), ends


def _names(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    sums = [np.r_[_U(0), np.cumsum(mix(flat + _U(k)), dtype=_U)] for k in (1, 2)]
    h1, h2 = (mix(s[ends[1:]] - s[ends[:-1]]) for s in sums)
    return h1, h2


def _prefix_sizes(n: np.ndarray, least: Fraction) -> np.ndarray:
    """n-grams of which one is common with any other set that reaches the threshold. Sets too small to
    reach it with any set but an equal one have none."""
    n, num, den = n.astype(np.int64), least.numerator, least.denominator
    return np.where((n == 0) | (n * den < (n + 1) * num), 0, n - -(-n * num // den) + 1)


def _summaries(n: int):
    """Per document: its size and a 128-bit hash of its set. Per partition: its part of the sketch."""
    names = ["doc_id", "n", "h1", "h2", "shard", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in small_batches(batches, 512):
            flat, ends = _flat(_sets(batch, n))
            sketch += np.bincount((flat >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            h1, h2 = _names(flat, ends)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        for shard, part in enumerate(sketch.reshape(SKETCH_SHARDS, -1)):
            own = np.flatnonzero(part)
            if len(own):
                packed = own.astype(np.uint32).tobytes() + part[own].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([shard], pa.int32()), pa.array([packed], pa.binary())], names)

    return run, "doc_id long, n int, h1 long, h2 long, shard int, counts binary"


def hot_counters(parts: DataFrame) -> tuple[np.ndarray, int]:
    """Which counters of the sketch hold n-grams too frequent for a range, and how many n-grams there are."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for frame in frames:
            for shard, packed in zip(frame["shard"], frame["counts"]):
                k = len(packed) // 8
                total = totals.setdefault(int(shard), np.zeros((1 << SKETCH_BITS) // SKETCH_SHARDS, np.int64))
                total[np.frombuffer(packed, np.uint32, k)] += np.frombuffer(packed, np.uint32, k, 4 * k)
        for shard, total in totals.items():
            yield pd.DataFrame({"shard": [shard], "counts": [total.tobytes()]})

    # of fixed size: 2 ** SKETCH_BITS counters, however many documents
    merged = parts.select("shard", "counts").repartition(SKETCH_SHARDS, "shard").mapInPandas(add, "shard int, counts binary").collect()
    counts = np.zeros((SKETCH_SHARDS, (1 << SKETCH_BITS) // SKETCH_SHARDS), np.int64)
    for r in merged:
        counts[r["shard"]] = np.frombuffer(r["counts"], np.int64)
    total = int(counts.sum())
    return counts.ravel() > counts.mean() + max(1, min(total // HOT_SHARE, RANGE_GRAMS // 2)), total


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """True for the first of the rows that are equal in all keys."""
    order = np.lexsort(keys)
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    out = np.ones(len(order), bool)
    out[order[again]] = False
    return out


def _packed(part: np.ndarray, of: np.ndarray, token: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """part, runs, tokens for each part that n-grams are dealt to; of: the run of each n-gram, in order."""
    order = np.argsort(part, kind="stable")
    part, of, token = part[order], of[order], token[order]
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
    own = runs[of[new]]
    own["k"] = np.diff(np.r_[new, len(of)])
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(of) else new
    by = np.searchsorted(new, at)
    for a, b, i, j in zip(at, np.r_[at[1:], len(of)], by, np.r_[by[1:], len(new)]):
        yield int(part[a]), own[i:j].tobytes(), token[a:b].tobytes()


def _dealt(n: int, least: Fraction, bits: int, hot: np.ndarray):
    """Rows of one range of hashes: runs, and the 32 bits of each n-gram's hash that follow the range's. Hot
    n-grams, which come last in the global order, pass the ranges by: they go to the buckets of their sets."""
    flat_part = np.uint16 if bits < 16 else np.int64  # of narrow keys, a stable sort is a radix sort
    limit = min(8 * HELD_GRAMS, max(HELD_GRAMS, 32 << bits))

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        flat, size, h, g = (np.concatenate(x) for x in zip(*held))
        keep = _first_of_each(g, h) & (_prefix_sizes(size, least) > 0)
        flat = flat[np.repeat(keep, size)]
        size = size[keep]
        runs = np.empty(len(size), _RUN)
        runs["h"], runs["g"], runs["n"] = h[keep], g[keep], size
        of = np.repeat(np.arange(len(size)), size)
        token = (flat << _U(bits) >> _U(32)).astype(np.uint32)
        is_hot = hot[(flat >> _U(64 - SKETCH_BITS)).astype(np.int64)]
        out = list(_packed((flat >> _U(64 - bits)).astype(flat_part)[~is_hot], of[~is_hot], token[~is_hot], runs))
        whole = (flat >> _U(64 - bits) << _U(32) | token.astype(_U))[is_hot]
        bucket = (runs["h"][of[is_hot]] % _U(1 << bits)).astype(flat_part)
        out += [(b + (1 << bits), r, t) for b, r, t in _packed(bucket, of[is_hot], whole, runs)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["part", "runs", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams = [], 0
        for batch in small_batches(batches, 512):
            flat, ends = _flat(_sets(batch, n))
            h1, h2 = _names(flat, ends)
            held.append((flat, np.diff(ends), h1, (h2 & _U(0xFFFFFFFF)).astype(np.uint32)))
            grams += len(flat)
            if grams >= limit:
                yield flush(held)
                held, grams = [], 0
        if held:
            yield flush(held)

    return run, "part int, runs binary, tokens binary"


def _shared(bits: int):
    """Of one range: the n-grams that several sets have, and how frequent each is, by bucket of sets."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        is_hot = key[0] >= 1 << bits
        runs = np.concatenate([np.frombuffer(r, _RUN) for r in frame["runs"]])
        token = np.concatenate([np.frombuffer(t, _U if is_hot else np.uint32) for t in frame["tokens"]])
        once = _first_of_each(runs["n"], runs["g"], runs["h"])
        token, runs = token[np.repeat(once, runs["k"])], runs[once]
        of = np.repeat(np.arange(len(runs)), runs["k"])
        if is_hot:
            level = np.full(len(token), 255, np.uint8)
        else:
            _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
            several = counts[inverse] > 1
            level = np.minimum(np.log2(counts) * 8, 254).astype(np.uint8)[inverse][several]
            of, token = of[several], token[several].astype(_U) | _U(key[0]) << _U(32)
        bucket = (runs["h"][of] % _U(1 << bits)).astype(np.int64)
        pair = np.empty(len(token), [("t", "<u8"), ("l", "u1")])
        pair["t"], pair["l"] = token, level
        out = list(_packed(bucket, of, pair, runs))
        return pd.DataFrame({"bucket": np.array([x[0] for x in out], np.int32), "runs": [x[1] for x in out], "tokens": [x[2] for x in out]})

    return run, "bucket int, runs binary, tokens binary"


def _prefixes(least: Fraction):
    """Of one bucket of sets: those whose prefix holds a shared n-gram. own: n-grams that
    no other set has, which come first in the order; p1, p2: a 128-bit hash of the rest, prefix."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        runs = np.concatenate([np.frombuffer(r, _RUN) for r in frame["runs"]])
        pair = np.concatenate([np.frombuffer(t, [("t", "<u8"), ("l", "u1")]) for t in frame["tokens"]])
        first = _first_of_each(runs["n"], runs["g"], runs["h"])
        order = np.lexsort((runs["n"], runs["g"], runs["h"]))  # stable: the first of equal ones comes first
        doc = np.empty(len(runs), np.int64)
        doc[order] = np.cumsum(first[order]) - 1
        sets = runs[order][first[order]]
        of = np.repeat(doc, runs["k"])
        by = np.lexsort((pair["t"], pair["l"], of))
        of, token = of[by], pair["t"][by]
        count = np.bincount(of, minlength=len(sets))
        own = sets["n"].astype(np.int64) - count
        keep = np.maximum(_prefix_sizes(sets["n"], least) - own, 0)
        token = token[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) < keep[of]]
        live = np.flatnonzero(keep > 0)
        ends = np.r_[0, np.cumsum(keep[live])]
        sums = [np.r_[_U(0), np.cumsum(mix(token + _U(k)), dtype=_U)][ends] for k in (3, 4)]
        p1, p2 = (mix(s[1:] - s[:-1]).view(np.int64) for s in sums)
        return pd.DataFrame({"h1": sets["h"][live].view(np.int64), "g": sets["g"][live].astype(np.int64), "n": sets["n"][live].astype(np.int32), "own": own[live].astype(np.int32),
                             "p1": p1, "p2": p2, "prefix": pd.Series(np.split(token.view(np.int64), ends[1:-1]) if len(live) else [], dtype=object)})

    return run, "h1 long, g long, n int, own int, p1 long, p2 long, prefix array<long>"


def rarest_prefixes(base: DataFrame, n: int, least: Fraction, hot: np.ndarray, total: int) -> DataFrame:
    """h1, g, n, own, p1, p2, prefix of the sets of base (doc_id, text) that may link with another."""
    bits = max(5, (total // RANGE_GRAMS).bit_length())
    run, schema = _dealt(n, least, bits, hot)
    dealt = base.mapInArrow(run, schema)
    run, schema = _shared(bits)
    shared = dealt.groupBy("part").applyInPandas(run, schema)
    run, schema = _prefixes(least)
    return shared.groupBy("bucket").applyInPandas(run, schema)


def gram_sets(base: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """sid, n, grams (sorted 64-bit hashes), outline of nodes (sid, doc_id, n, h1, h2), from the texts of
    base (doc_id, text)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 512):
            sets = _sets(batch, n)
            h1, h2 = _names(*_flat(sets))
            outlines = []
            for s in sets:
                bits = np.zeros(64 * OUTLINE, bool)
                bits[(s & _U(64 * OUTLINE - 1)).astype(np.int64)] = True
                outlines.append(np.packbits(bits).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * OUTLINE), pa.array(np.concatenate(outlines)) if outlines else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary()), lists], ["h1", "h2", "grams", "outline"])

    texts = base.join(sized(cut(nodes.select("doc_id").distinct())), "doc_id", "left_semi")
    found = texts.mapInArrow(full, "h1 long, h2 long, grams binary, outline array<long>")
    return found.join(nodes.hint("merge"), ["h1", "h2"]).dropDuplicates(["sid"]).select("sid", "n", "grams", "outline")


def verify(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b: sids) whose sets (sid, grams) reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
                keep.append(both * least.denominator >= (len(a) + len(b) - both) * least.numerator)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = sets.select("sid", "grams")
    # the first of a pair is the one that many pairs share: its set moves once, not with each pair
    joined = pairs.join(known.toDF("b", "y").hint("merge"), "b").join(known.toDF("a", "x").hint("merge"), "a").select("a", "b", "x", "y")
    return joined.mapInArrow(compare, "a long, b long")


def _meet(least: Fraction):
    """Pairs of the entries of each (token, i, j), which come sorted by size; batches may cut a group."""
    ratio, num, den = float(least), least.numerator, least.denominator

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, i, j, block, gid, comp, size, at = (table.column(c).to_numpy() for c in range(8))
        every, some = (table.column(c).combine_chunks().flatten().to_numpy().view(_U).reshape(-1, OUTLINE) for c in (8, 9))
        earlier = [(table.column(10 + k).is_valid().to_numpy(), table.column(10 + k).fill_null(0).to_numpy()) for k in range(EARLIER)]
        new = np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(new).astype(np.int64) << 32
        key = group + size
        lo = np.searchsorted(key, key, "left")
        hi = np.searchsorted(key, group + np.floor(size / ratio + 1e-6).astype(np.int64), "right")
        count = hi - lo
        ends = np.cumsum(count)
        for part in np.split(np.arange(len(size)), np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS))):
            n = count[part]
            a = np.repeat(part, n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)
            # what they must share; of what they share, the first n-gram has at least that many at and after it
            need = -(-(size[a] + size[b]) * num // (num + den))
            ok = (comp[a] != comp[b]) & ((size[b] > size[a]) | (b > a)) & ((i[a] == j[a]) | (block[a] != block[b])) & (at[a] <= size[a] - need) & (at[b] <= size[b] - need)
            a, b, need = a[ok], b[ok], need[ok]
            # a bit that every member of one group and no member of the other has is an n-gram that these lack
            lacks = [np.bitwise_count(every[x] & ~some[y]).sum(1, dtype=np.int64) for x, y in ((a, b), (b, a))]
            ok = (size[a] - lacks[0] >= need) & (size[b] - lacks[1] >= need)
            a, b = a[ok], b[ok]
            # a pair that shares an earlier n-gram is made in that one's bucket, where it passes as well
            made = np.zeros(len(a), bool)
            for has_a, x in earlier:
                for has_b, y in earlier:
                    made |= has_a[a] & has_b[b] & (x[a] == y[b])
            yield pa.record_batch([pa.array(gid[a[~made]]), pa.array(comp[a[~made]]), pa.array(gid[b[~made]]), pa.array(comp[b[~made]])], names=["ga", "ca", "gb", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, i, j = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            first, end = (token[0], i[0], j[0]), int(cuts[-1]) if len(cuts) else 0
            if held and first != last:
                yield from pairs(pa.Table.from_batches(held).combine_chunks())
                held = []
            if end:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks())
                held = []
            held.append(batch.slice(end))
            last = (token[-1], i[-1], j[-1])
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run, "ga long, ca long, gb long, cb long"


def jaccard_components(docs: DataFrame, n: int = 3, threshold: float = 0.9) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Sets of n-word runs (fewer words: the whole sequence) link when their Jaccard similarity is at least
    threshold; component_id is the smallest doc_id reachable. Documents without words, or null text,
    link with nothing, not even each other. A row with a null doc_id takes no part in links: its
    component_id is null. Rows that repeat get equal results; rows of one doc_id with different texts
    are documents of their own, which only share the number. An empty table gives an empty result; other
    columns are ignored."""
    least = Fraction(str(threshold))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    run, schema = _summaries(n)
    first = cut(base.mapInArrow(run, schema))
    rows = first.where("shard is null").select("doc_id", "n", "h1", "h2")
    hot, total = hot_counters(first.where("shard is not null"))

    # equal sets are one class, read from the text of its smallest doc_id
    known = rows.where("n > 0 and doc_id is not null")
    classes = cut(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("sid", F.monotonically_increasing_id()))
    prefixes = cut(rarest_prefixes(base.where("doc_id is not null"), n, least, hot, total))
    low = F.col("h2").bitwiseAND(F.lit(0xFFFFFFFF))
    sets = cut(prefixes.join(classes.withColumn("g", low).hint("merge"), ["h1", "g", "n"]).drop("g"))
    discard(prefixes)

    # identical prefix and size: one group, named by its smallest member
    groups = sets.groupBy("n", "own", "p1", "p2").agg(F.min("sid").alias("gid"))
    member = cut(sets.drop("prefix", "doc_id", "h1", "h2").join(groups.hint("merge"), ["n", "own", "p1", "p2"]).select("sid", "gid", "n", "own"))
    lead = sets.join(member.where("sid = gid").select("sid").hint("merge"), "sid")
    tokens = lead.select(F.col("sid").alias("gid"), "n", F.posexplode("prefix").alias("place", "token"), "own").withColumn("place", F.col("place") + F.col("own"))
    # the first of a bucket has the fewest n-grams of its own: of near copies, the one nearest to all
    tokens = cut(tokens)
    buckets = tokens.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("own", "gid")).alias("pivot")).where("size > 1")
    shared = cut(tokens.drop("own").join(buckets.hint("merge"), "token"))
    discard(tokens)

    # every class with the first of its group, every group with the first of one of its buckets
    near = member.where("sid <> gid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))
    across = shared.where("gid <> pivot.gid").groupBy("gid").agg(F.min("pivot").alias("a")).select("a.gid", F.col("gid").alias("b")).toDF("a", "b")
    ids = near.select("a").union(near.select("b")).union(shared.select("gid")).distinct().toDF("sid")
    # members of a group that meets another one are looked at too
    more = member.join(shared.select("gid").distinct().hint("merge"), "gid", "left_semi").select("sid")
    nodes = cut(sets.select("sid", "doc_id", "n", "h1", "h2").join(ids.union(more).distinct().hint("merge"), "sid"))
    grams = cut(gram_sets(base, nodes, n))
    links = cut(verify(near.union(across), grams, least))
    comps = connected_components(links)

    # exactly the rest: pairs of different components that share a prefix n-gram
    of = cut(member.join(sized(comps.toDF("sid", "comp"), "merge"), "sid", "left").select("sid", "gid", F.coalesce("comp", "sid").alias("comp")))
    spread = of.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = shared.join(spread.hint("merge"), "gid").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    entries = shared.drop("pivot").join(mixed.hint("merge"), "token")
    before = Window.partitionBy("gid").orderBy("place", "token").rowsBetween(Window.unboundedPreceding, -1)
    entries = cut(entries.withColumns({f"e{k}": F.nth_value("token", k + 1).over(before) for k in range(EARLIER)}))
    looked = of.join(entries.select("gid").distinct().hint("merge"), "gid", "left_semi")
    bit = lambda name, f: F.array(*[f(F.col("outline")[k]) for k in range(OUTLINE)]).alias(name)
    parts = looked.join(grams.select("sid", "outline").hint("merge"), "sid").groupBy("gid", "comp").agg(bit("every", F.bit_and), bit("some", F.bit_or))
    entries = entries.join(cut(parts).hint("merge"), "gid")
    entries = entries.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    dealt = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "gid", "comp", F.col("n").cast("long").alias("n"), "place", "every", "some", *[f"e{k}" for k in range(EARLIER)])
    run, schema = _meet(least)
    met = cut(dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "gid", "comp").mapInArrow(run, schema).distinct())
    if not met.isEmpty():
        # one pair for each two parts of components first: most of them are one component then
        lead = cut(of.groupBy("gid", "comp").agg(F.min("sid").alias("sid")).select("sid", "gid", "comp"))
        x, y = lead.toDF("a", "ga", "ca"), lead.toDF("b", "gb", "cb")
        tried = met.join(x.hint("merge"), ["ga", "ca"]).join(y.hint("merge"), ["gb", "cb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        comps = extend_components(comps, cut(verify(tried, grams, least)))
        now = comps.toDF("ca", "na")
        apart = met.join(sized(now, "merge"), "ca", "left").join(sized(now.toDF("cb", "nb"), "merge"), "cb", "left")
        apart = cut(apart.where(F.coalesce("na", "ca") != F.coalesce("nb", "cb")).select("ga", "ca", "gb", "cb"))
        if not apart.isEmpty():
            x, y = of.toDF("a", "ga", "ca"), of.toDF("b", "gb", "cb")
            rest = apart.join(x.hint("merge"), ["ga", "ca"]).join(y.hint("merge"), ["gb", "cb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            comps = extend_components(comps, cut(verify(rest, grams, least)))

    # a component is named by its smallest doc_id
    named = classes.join(sized(comps.toDF("sid", "comp"), "merge"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least_id = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(least_id.hint("merge"), "comp").select("n", "h1", "h2", "component_id"))
    out = rows.join(named.hint("merge"), ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
