"""Hierarchical density clusters against a plain version of the whole definition."""

import itertools
import math

import numpy as np
import pytest

from docstrata.operators import hierarchy
from docstrata.operators.hierarchy import blocks, hierarchical_clusters, neighbours
from docstrata.plans.corpus import written


def brute(points, least=2):
    """Sets of vectors by their densities: all thresholds from the largest down, parts of the graph at each."""
    n = len(points)
    if n < 2:
        return [-1] * n
    x = [p / np.linalg.norm(p) for p in np.asarray(points, float)]
    d = [[float(np.linalg.norm(a - b)) for b in x] for a in x]
    core = [sorted(row)[min(least, n - 1)] for row in d]
    reach = {(i, j): max(d[i][j], core[i], core[j]) for i, j in itertools.combinations(range(n), 2)}

    def parts(members, below):
        out, rest = [], set(members)
        while rest:
            part, todo = set(), [rest.pop()]
            while todo:
                v = todo.pop()
                part.add(v)
                near = {u for u in rest if reach[min(u, v), max(u, v)] < below}
                rest -= near
                todo += near
            out.append(part)
        return out

    def lasts(members, born):
        """The stability of a cluster and the clusters that it splits into, each with the density at which it appears."""
        inside, stability = set(members), 0.0
        for t in sorted(set(reach.values()), reverse=True):
            split = parts(inside, t)
            if len(split) == 1:
                continue
            density = 1 / max(t, 1e-9)
            large = [p for p in split if len(p) >= least]
            if len(large) >= 2:
                return stability + (density - born) * len(inside), [(p, density) for p in large]
            gone = inside - (large[0] if large else set())
            stability += (density - born) * len(gone)
            inside -= gone
            if not inside:
                break
        return stability, []

    def choose(members, born, root=False):
        stability, below = lasts(members, born)
        picks = [choose(m, b) for m, b in below]
        total, chosen = sum(t for t, _ in picks), [c for _, cs in picks for c in cs]
        if not root and stability >= total:
            return stability, [members]
        return total, chosen

    labels = [-1] * n
    for cluster in choose(set(range(n)), 0.0, root=True)[1]:
        for v in cluster:
            labels[v] = min(cluster)
    return labels


def points(seed, n=40, dims=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dims))
    return [centers[i % 4] * rng.uniform(0.5, 2) + rng.normal(size=dims) * (0.1 if i % 5 else 0.8) for i in range(n)]


def frame(spark, projects):
    rows = [(1000 * p + i, p, [float(v) for v in x], "x") for p, xs in projects.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "artifact_id long, project_id int, vector array<double>, u string")


def test_against_brute_force(spark):
    projects = {p: points(p, n) for p, n in ((1, 40), (2, 25), (3, 9), (4, 3), (5, 2), (6, 1))}
    df = frame(spark, projects).unionByName(spark.createDataFrame([(7000, 7, None, "x")], "artifact_id long, project_id int, vector array<double>, u string"))
    got = {r.artifact_id: r.cluster_id for r in hierarchical_clusters(df, written).collect()}
    for p, xs in projects.items():
        want = [1000 * p + c if c >= 0 else -1 for c in brute(xs)]
        assert [got[1000 * p + i] for i in range(len(xs))] == want, p
    assert len(got) == 80 and len({c for c in got.values()}) > 6
    assert hierarchical_clusters(df.limit(0), written).collect() == []


def test_equal_vectors_and_larger_clusters(spark):
    xs = [[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 4 + [[-1.0, -1.0]]
    got = [r.cluster_id for r in hierarchical_clusters(frame(spark, {1: xs}), written).orderBy("artifact_id").collect()]
    assert got == [1000] * 5 + [1005] * 4 + [-1]


def test_clusters_do_not_depend_on_the_order_of_rows(spark):
    """Mutual reachability has ties: the same tree must be walked however the rows arrive."""
    rng = np.random.default_rng(11)
    rows = [(1000 + i, 1, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    labels = []
    for order in (rows, rows[::-1], rows[150:] + rows[:150]):
        df = spark.createDataFrame(order, "artifact_id long, project_id int, vector array<double>").coalesce(1)
        labels.append({r.artifact_id: r.cluster_id for r in hierarchical_clusters(df, written).collect()})
    assert labels[0] == labels[1] == labels[2]


@pytest.mark.parametrize("n", [600])
def test_large_projects_by_tables(spark, monkeypatch, n):
    """Well separated clusters in a project of several blocks: found whole, with pairs in proportion to n."""
    monkeypatch.setattr(hierarchy, "BLOCK", 100)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16)) * 3
    xs = [centers[i % 8] + rng.normal(size=16) * 0.15 for i in range(n)]
    df = frame(spark, {1: xs, 2: points(1, 20)})
    got = {r.artifact_id: r.cluster_id for r in hierarchical_clusters(df, written, min_cluster_size=20).collect()}
    for c in range(8):
        own = [got[1000 + i] for i in range(n) if i % 8 == c]
        named = max(set(own), key=own.count)
        assert named >= 0 and own.count(named) > 0.9 * len(own)
        assert (named - 1000) % 8 == c


def test_near_neighbours_share_a_block(spark, monkeypatch):
    """Recall of the two nearest others, and how many pairs are compared, at two sizes of one project."""
    monkeypatch.setattr(hierarchy, "BLOCK", 64)
    compared, recall = [], []
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        centers = rng.normal(size=(n // 10, 24))
        x = np.array([centers[i % len(centers)] + rng.normal(size=24) * 0.2 for i in range(n)])
        x /= np.linalg.norm(x, axis=1)[:, None]
        units = spark.createDataFrame([(1, i, [float(v) for v in row]) for i, row in enumerate(x)], "project_id int, artifact_id long, u array<double>")
        dealt = blocks(units, units.groupBy("project_id").count().withColumnRenamed("count", "n")).cache()
        compared.append(sum(r["count"] ** 2 for r in dealt.groupBy("block").count().collect()))
        found = {(r.a, r.b) for r in neighbours(dealt).collect()}
        d = ((x[:, None] - x) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1)[:, :2]
        recall.append(sum((i, int(j)) in found for i in range(n) for j in near[i]) / (2 * n))
    assert min(recall) > 0.8 and math.log(compared[1] / compared[0], 4) < 1.5
