"""Hierarchical density clustering of document vectors, a project at a time.

A vector's core distance is that to its k-th nearest other one; two vectors are as far apart as the largest of their distance
and their core distances. The minimum spanning tree under this distance, cut from its longest edge down, is a hierarchy
of clusters; a cluster lasts from the density at which it appears to that at which it splits or dissolves, and the
clusters chosen are those whose members last longest in sum.

Many edges have the same weight, that of a core distance. So vectors are taken in the order of their ids, and clusters don't depend on
the order in which rows arrive.

Distances are taken within blocks of bounded size. A project that fits one block is exact. Of a larger one, each of TABLES
tables deals the vectors by the signs of their products with random directions, as many as leave BLOCK / 2 to a bucket on
average, and splits crowded buckets by a hash; near vectors share a block in some table. So the pairs compared grow in
proportion to a project's vectors. The tree is then found by Boruvka rounds on the edges to the nearest neighbours;
parts that these leave apart are joined through one vector of each part, in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import normalized

#: Vectors whose distances one task takes, tables of directions, nearest neighbours kept of each vector and block.
BLOCK = 2000
TABLES = 6
NEIGHBOURS = 8
#: Distance of vectors that are equal: a density must be finite.
LEAST_DISTANCE = 1e-9

Keep = Callable[[DataFrame], DataFrame]
_EDGE = "project_id int, a long, b long, w double"


def distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))
    d[d < 1e-7] = 0  # rounding of equal vectors
    np.fill_diagonal(d, 0)
    return d


def spanning_tree(ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Edges of the minimum spanning tree of x under mutual reachability, by Prim's walk."""
    n = len(x)
    if n < 2:
        return []
    d = distances(x)
    core = np.partition(d, min(k, n - 1), axis=1)[:, min(k, n - 1)]  # place 0 is the vector itself
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    best, source, out = reach[0].copy(), np.zeros(n, int), []
    best[0] = np.inf
    done = np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        v = int(np.where(done, np.inf, best).argmin())
        out.append((int(ids[source[v]]), int(ids[v]), float(best[v])))
        done[v] = True
        nearer = ~done & (reach[v] < best)
        best[nearer], source[nearer] = reach[v][nearer], v
    return out


def linkage(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """left, right, distance, size of each merge; merge i makes node n + i."""
    parent, size = np.arange(2 * n - 1), np.ones(2 * n - 1)
    out = np.empty((len(a), 4))

    def find(v: int) -> int:
        root = v
        while parent[root] != root:
            root = parent[root]
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    for i, e in enumerate(np.lexsort((b, a, w)).tolist()):
        left, right, node = find(a[e]), find(b[e]), n + i
        parent[left] = parent[right] = node
        size[node] = size[left] + size[right]
        out[i] = left, right, w[e], size[node]
    return out


def condensed(merges: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """parent, child, density, size: what leaves each cluster and at which density. Clusters are numbered from n, the
    root; children below n are vectors."""
    out, clusters = [], 1
    open_ = [(2 * n - 2, n)]
    while open_:
        node, cluster = open_.pop()
        left, right, d = int(merges[node - n, 0]), int(merges[node - n, 1]), merges[node - n, 2]
        density = 1 / max(d, LEAST_DISTANCE)
        sizes = [int(merges[v - n, 3]) if v >= n else 1 for v in (left, right)]
        for v, size in zip((left, right), sizes):
            if size >= least and min(sizes) >= least:  # a split
                out.append((cluster, n + clusters, density, size))
                if v >= n:
                    open_.append((v, n + clusters))
                else:
                    out.append((n + clusters, v, density, 1))
                clusters += 1
            elif size >= least:  # the cluster goes on
                open_.append((v, cluster))
            else:
                inside = [v]
                while inside:
                    u = inside.pop()
                    if u < n:
                        out.append((cluster, u, density, 1))
                    else:
                        inside += [int(merges[u - n, 0]), int(merges[u - n, 1])]
    return out


def stable_labels(tree: list[tuple[int, int, float, int]], n: int) -> np.ndarray:
    """The chosen cluster of each vector, -1 for noise. The root isn't chosen."""
    born = {n: 0.0} | {child: density for _, child, density, _ in tree if child >= n}
    stability, children, parent = dict.fromkeys(born, 0.0), {c: [] for c in born}, np.full(n, n)
    above = {}
    for cluster, child, density, size in tree:
        stability[cluster] += (density - born[cluster]) * size
        if child >= n:
            children[cluster].append(child)
            above[child] = cluster
        else:
            parent[child] = cluster
    total, chosen = {}, set()
    for c in sorted(born, reverse=True):  # children have larger numbers
        below = sum(total[x] for x in children[c])
        total[c] = max(stability[c], below)
        if c != n and stability[c] >= below:
            chosen.add(c)
    of: dict[int, int] = {n: -1}
    for c in sorted(born):  # of nested ones the outermost
        if c != n:
            of[c] = of[above[c]] if of[above[c]] >= 0 else c if c in chosen else -1
    return np.array([of[int(p)] for p in parent], np.int64)


def tree_labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """A cluster of each id, named by its smallest member, from the edges of a spanning tree; -1 for noise."""
    n = len(ids)
    if n < 2:
        return np.full(n, -1, np.int64)
    order = np.argsort(ids)
    at = lambda v: order[np.searchsorted(ids, v, sorter=order)]
    label = stable_labels(condensed(linkage(at(a), at(b), w, n), n, least), n)
    out = np.full(n, -1, np.int64)
    for c in np.unique(label[label >= 0]):
        out[label == c] = ids[label == c].min()
    return out


def _unit(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def blocks(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """project_id, block, artifact_id, u: the vectors (project_id, artifact_id, u) of large projects (sizes: project_id,
    n), once for each table."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, n = _unit(frame["u"]), frame["n"].to_numpy()
            bits = np.ceil(np.log2(np.maximum(2 * n / BLOCK, 1))).astype(int)
            for t in range(TABLES):
                planes = np.random.default_rng(t).normal(size=(x.shape[1], 48))
                signs = (x @ planes > 0) & (np.arange(48) < bits[:, None])
                frame["bucket"] = signs @ (1 << np.arange(48))
                frame["table"] = t
                yield frame[["project_id", "table", "bucket", "artifact_id", "u"]]

    dealt = units.join(sizes.hint("merge"), "project_id").mapInPandas(deal, "project_id int, table int, bucket long, artifact_id long, u array<double>")
    at = ["project_id", "table", "bucket"]
    crowds = dealt.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
    piece = F.pmod(F.xxhash64("table", "artifact_id"), F.col("pieces"))
    return dealt.join(crowds.hint("merge"), at).select("project_id", F.concat_ws("-", "table", "bucket", piece).alias("block"), "artifact_id", "u")


def neighbours(dealt: DataFrame) -> DataFrame:
    """project_id, a, b, d: the nearest others of each vector in each of its blocks, each pair once."""

    def near(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("artifact_id")
        ids, d = frame["artifact_id"].to_numpy(), distances(_unit(frame["u"]))
        np.fill_diagonal(d, np.inf)
        k = min(NEIGHBOURS, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"project_id": [], "a": [], "b": [], "d": []})
        to = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"project_id": key[0], "a": np.repeat(ids, k), "b": ids[to].ravel(), "d": np.take_along_axis(d, to, 1).ravel()})

    found = dealt.groupBy("project_id", "block").applyInPandas(near, "project_id int, a long, b long, d double")
    return found.groupBy("project_id", "a", "b").agg(F.min("d").alias("d"))


def spanning_forest(edges: DataFrame, ids: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) of the minimum spanning forest of edges, and the part of each of ids (project_id, id). In a round,
    each part takes its least edge to another; equal weights are ordered by the ends, so parts never close a longer ring."""
    parts, taken = keep(ids.select("project_id", "id", F.col("id").alias("part"))), None
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct()
    of = lambda end: parts.select(F.col("id").alias(end), F.col("part").alias(f"p{end}")).hint("merge")
    while True:
        edges = keep(edges.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").where("pa <> pb"))
        both = edges.select(F.col("pa").alias("part"), F.struct("w", "a", "b", F.col("pb").alias("other")).alias("e")).unionByName(edges.select(F.col("pb").alias("part"), F.struct("w", "a", "b", F.col("pa").alias("other")).alias("e")))
        least = keep(both.groupBy("part").agg(F.min("e").alias("e")).select("part", "e.*"))
        if least.isEmpty():
            return taken if taken is not None else edges.select("a", "b", "w"), parts
        new = least.select("a", "b", "w").distinct()
        taken = new if taken is None else taken.unionByName(new)
        back = least.select(F.col("part").alias("other"), F.col("other").alias("back"))
        root = least.select("part", "other").join(back.hint("merge"), "other").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("other")), F.col("part")).otherwise(F.col("other")).alias("root"))
        root = keep(root)
        while True:  # the root of the root, until all are
            up = root.select(F.col("part").alias("root"), F.col("root").alias("next"))
            after = keep(root.join(up.hint("merge"), "root").select("part", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            root = after.drop("moved")
            if after.where("moved").isEmpty():
                break
        parts = keep(parts.join(root.hint("merge"), "part", "left").select("project_id", "id", F.coalesce("root", "part").alias("part")))


def large_trees(units: DataFrame, k: int, keep: Keep) -> DataFrame:
    """project_id, a, b, w: spanning trees of large projects, over near neighbours."""
    core, out, left = None, None, units
    while True:
        sizes = left.groupBy("project_id").agg(F.count("*").alias("n")).where("n > 1")
        pairs = keep(neighbours(blocks(left, sizes)))
        if core is None:
            nth = F.row_number().over(W.partitionBy("a").orderBy("d", "b"))
            core = keep(pairs.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("a").agg(F.max("d").alias("core")))
        of = lambda end: core.select(F.col("a").alias(end), F.col("core").alias(f"c{end}")).hint("merge")
        weighed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))
        edges, parts = spanning_forest(weighed, left.select("project_id", F.col("artifact_id").alias("id")), keep)
        named = edges.join(left.select("project_id", F.col("artifact_id").alias("a")).hint("merge"), "a").select("project_id", "a", "b", "w")
        out = keep(named if out is None else out.unionByName(named))
        heads = parts.where("id = part").select("project_id", F.col("id").alias("artifact_id"))
        many = heads.groupBy("project_id").agg(F.count("*").alias("n")).where("n > 1").select("project_id")
        left = keep(left.join(heads.join(many.hint("merge"), "project_id").select("artifact_id").hint("merge"), "artifact_id").select("project_id", "artifact_id", "u"))
        if left.isEmpty():
            return out


def hierarchical_clusters(vectors: DataFrame, keep: Keep, min_cluster_size: int = 2) -> DataFrame:
    """artifact_id, project_id, cluster_id of vectors (artifact_id, project_id, vector): the most stable clusters of at least
    min_cluster_size, named by their smallest member; -1 is noise, and so is a project's only vector. Vectors are
    brought to length one; null vectors take no part; artifact_id is unique. keep writes a table to the shared folder and reads it again.

    The last step, cutting a project's tree of n - 1 edges, holds about 200 bytes for each of its vectors in one task."""
    k = max(1, min_cluster_size)
    units = keep(vectors.where("vector is not null").select(F.col("project_id").cast("int").alias("project_id"), F.col("artifact_id").cast("long").alias("artifact_id"), normalized(F.col("vector")).alias("u")))
    sizes = units.groupBy("project_id").agg(F.count("*").alias("n"))
    small, large = (units.join(sizes.where(rule).select("project_id").hint("merge"), "project_id", "left_semi") for rule in (f"n <= {BLOCK}", f"n > {BLOCK}"))

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("artifact_id")
        edges = spanning_tree(frame["artifact_id"].to_numpy(), _unit(frame["u"]), k)
        return pd.DataFrame([(key[0], *e) for e in edges], columns=["project_id", "a", "b", "w"])

    trees = small.groupBy("project_id").applyInPandas(whole, _EDGE)
    if not large.isEmpty():
        trees = trees.unionByName(large_trees(keep(large), k, keep))

    def cut(key: tuple, members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(members["artifact_id"].to_numpy())
        label = tree_labels(ids, edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy(), min_cluster_size)
        return pd.DataFrame({"artifact_id": ids, "project_id": key[0], "cluster_id": label})

    members = units.select("project_id", "artifact_id").groupBy("project_id")
    return members.cogroup(keep(trees).groupBy("project_id")).applyInPandas(cut, "artifact_id long, project_id int, cluster_id long")
