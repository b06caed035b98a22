import numpy as np
import pytest

from imagora.llm import ann


def table(spark, ids, vectors):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 1, "c") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int, block string").repartition(3)


def run(df, **kw):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, **kw).collect())


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if scale:
        v *= rng.uniform(0.2, 3, (3000, 1))
    ids = np.arange(3000)
    got = run(table(spark, ids, v), block=1500)
    want = list(ann.brute_force(ids, v))
    assert len(got) == len(want) == 150 * 20
    exact = {(q, i): s for q, _, i, s in want}
    assert len({(q, i) for q, _, i, _ in got} & set(exact)) / len(exact) >= 0.9
    assert all(s == (v[i] * v[q]).sum() for q, _, i, s in got)
    for q in {g[0] for g in got}:
        mine = [(-s, i) for a, _, i, s in got if a == q]
        assert mine == sorted(mine)


def test_copies_tie_by_id_and_small_tables_are_complete(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 8))
    v[5:25] = v[0]
    ids = np.arange(30)
    got = run(table(spark, ids, v))
    want = sorted(ann.brute_force(ids, v))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    few = run(table(spark, ids[:6], v[:6]))
    assert [g[:3] for g in few] == [w[:3] for w in sorted(ann.brute_force(ids[:6], v[:6]))]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 7, 20]
    v = [[1, 0], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [], [2, 1], [2, 1], [1, 1, 1]]
    got = run(table(spark, ids, v))
    assert got == [(0, 1, 7, 2.0), (0, 2, 7, 2.0)]
    assert ann.search(table(spark, [], [])).count() == 0
