from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftworks.llm import nearest as N
from siftworks.llm.nearest import nearest

SCHEMA = "vec_id long, embedding array<float>, code string, score string"


def vectors(n, dim, seed):
    return [[float(np.float32(x)) for x in row] for row in np.random.default_rng(seed).standard_normal((n, dim))]


def brute(rows, k=5, every=50):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(v, best.get(i, v))
    found = {}
    for q, a in best.items():
        if q % every == 0:
            a = np.array(a)
            others = [
                (-float((np.array(b) * a).sum() / (np.sqrt((np.array(b) ** 2).sum()) * np.sqrt((a * a).sum()))), i)
                for i, b in best.items()
                if i != q and len(b) == len(a)
            ]
            found[q] = [(i, -s) for s, i in sorted(others)[:k]]
    return found


def search(frame, rows, **how):
    result = nearest(frame([(i, v, "x", "x") for i, v in rows], SCHEMA), **how)
    found = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = found.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return found


def close(a, b):
    return a.keys() == b.keys() and all(
        [i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=1e-12) for q in b
    )


def test_awkward_vectors_and_ties(frame):
    rows = [(i, v) for i, v in enumerate(vectors(120, 16, 1))]
    rows += [(200 + i, rows[50][1]) for i in range(12)]  # more equal vectors than are asked for
    rows += [(50, rows[50][1]), (300, None), (350, []), (400, [0.0] * 16), (450, [float("nan")] * 16), (500, [None] * 16)]
    rows += [(550, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (650, [1.0, 2.0, 3.0])]
    found, wanted = search(frame, rows), brute(rows)
    wanted.pop(650)  # no other vector of its length
    assert [i for i, _ in found[50]] == [200, 201, 202, 203, 204]
    assert close(found, wanted)


def test_recall_on_vectors_without_clusters(frame):
    rows = list(enumerate(vectors(3000, 32, 2)))
    found, wanted = search(frame, rows, sample_rows=500), brute(rows)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert found.keys() == wanted.keys() and hits >= 0.95 * 5 * len(wanted)


def test_clusters_are_answered_by_probing(frame):
    rng, rows = np.random.default_rng(3), []
    for c, centre in enumerate(vectors(20, 32, 4)):
        rows += [(50 * c + j, [float(np.float32(x)) for x in np.array(centre) + 0.02 * rng.standard_normal(32)]) for j in range(12)]
    found, wanted = search(frame, rows), brute(rows)
    assert all({i for i, _ in found[q]} == {i for i, _ in wanted[q]} for q in wanted)


def test_few_rows_and_none(frame):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])]
    assert close(search(frame, rows), brute(rows))
    assert search(frame, [(0, [1.0])]) == {} and search(frame, [(1, [1.0]), (2, [1.0])]) == {} and search(frame, []) == {}


def test_probing_passes_on_few_rows_of_a_cluster(frame):
    """Near copies of one vector: what probing gives for a query grows with blocks, not with the cluster, and is exact."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(32)
    vectors = centre + rng.standard_normal((1500, 32)) * 1e-3
    turn = N.rotations(N._unit(np.concatenate([vectors[:50], rng.standard_normal((400, 32))])))
    rows = frame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    coded = N._coded(rows, turn, 32, "vec_id")
    index = coded.withColumn("block", F.floor(F.col("vec_id") / 256))
    asked = N._coded(rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qkey"), turn, 32, "qkey")
    found = N._probed(asked, index, turn.shape[1], 32, 6).collect()
    assert len(found) <= 30 * 6 * 6
    for q in range(0, 1500, 50):
        score = N.cosines(vectors, vectors[q])
        best = np.lexsort((np.arange(1500), -score))[:6]
        own = sorted((-r["score"], r["vec_id"]) for r in found if r["qkey"] == q)[:6]
        assert own == [(-float(score[b]), int(b)) for b in best]
