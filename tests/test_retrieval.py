import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from imagora.operators import block_index, clustered, dense, fusion, hypothesis, lexical, retrievers, sizing
from imagora.plans import ablation_setup, eval_setup
from imagora.plans.tables import stage_path

DOCS = [("s0", "red green red blue"), ("s1", "green"), ("s2", "blue blue blue violet ochre umber"),
        ("s3", "ochre green grey grey"), ("s4", "teal"), ("s5", "umber violet grey teal teal red")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "instance_id int, query string")


def brute_bm25(corpus, query, k1=1.5, b=0.75):
    toks = {d: t.lower().split() for d, t in corpus}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for d, t in toks.items():
        s = 0.0
        for w in query.lower().split():
            if w in df:
                idf = max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 0.0)
                tf = t.count(w)
                s += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        out[d] = round(s, 6)
    return out


def ranked(df):
    return {(r.instance_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("salted", [False, True])
def test_bm25_matches_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(sizing, "fits_broadcast", lambda df, limit=0: False)
    qs = ["violet ochre red", "teal teal umber", "mauve"]
    got = ranked(lexical.bm25_topk(docs(spark), queries(spark, *qs), 5))
    want = {}
    for i, q in enumerate(qs):
        pos = sorted(((s, d) for d, s in brute_bm25(DOCS, q).items() if s > 0), key=lambda x: (-x[0], x[1]))
        want.update({(i, r): (d, s) for r, (s, d) in enumerate(pos, 1)})
    assert got == want
    assert {i for i, _ in got} == {0, 1}


def test_bm25_padding_fills_with_zero_in_id_order(spark):
    got = ranked(lexical.bm25_topk(docs(spark), queries(spark, "teal", "mauve"), 3, pad_zero=True))
    assert [got[(1, r)] for r in (1, 2, 3)] == [("s0", 0.0), ("s1", 0.0), ("s2", 0.0)]
    assert got[(0, 1)][0] == "s4" and got[(0, 2)][0] == "s5" and got[(0, 3)] == ("s0", 0.0)


def test_bm25_from_bucketed_index(spark):
    posts = lexical.postings(docs(spark))
    spark.sql("DROP TABLE IF EXISTS posts_test")
    lexical.write_index(posts, "posts_test", 4)
    q = queries(spark, "blue umber grey")
    assert ranked(lexical.bm25_topk(docs(spark), q, 5, index=spark.table("posts_test"))) == \
        ranked(lexical.bm25_topk(docs(spark), q, 5))
    spark.sql("DROP TABLE posts_test")


def zipf_docs(n, seed):
    """Texts of a skewed vocabulary, each with a rare word now and then."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{min(int(w), 400)}" for w in rng.zipf(1.3, rng.integers(1, 60))]
        rows.append((i, " ".join(words + [f"rare{rng.integers(0, n // 8)}"] * int(rng.random() < 0.5))))
    return rows


def test_block_index_equals_the_scan_and_skips_blocks(spark, tmp_path):
    rows = zipf_docs(3000, 1) + [(3000, None), (3001, ""), (3002, "w9 " * 500)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    rng = np.random.default_rng(2)
    texts = [" ".join([f"w{min(int(w), 400)}" for w in rng.zipf(1.4, 12)] + [f"rare{r}" for r in rng.integers(0, 375, 2)])
             for _ in range(12)] + ["w7 w7 w8", "rare3", "unknown words only", "", "w9"]
    asked = queries(spark, *texts)
    index = block_index.build(corpus, str(tmp_path), "block_index_test", block=16, buckets=8)
    for k in (1, 10, 50):
        got, first, second = index.search(asked, k)
        assert ranked(got) == ranked(lexical.bm25_topk(corpus, asked, k))
        if k == 10:
            terms = lexical.query_terms(asked)
            stored = index.weighted(terms).join(index.blocks, "token").count()
            assert first.count() + second.count() < stored * 0.8, (first.count(), second.count(), stored)
    # a scan that is not planned as bucketed opens the same files but does not say so
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    plan = index.named(lexical.query_terms(queries(spark, "rare3")))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    texts_read = got._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in texts_read
    spark.sql("DROP TABLE block_index_test")


def test_block_index_of_few_and_no_documents(spark, tmp_path):
    index = block_index.build(docs(spark), f"{tmp_path}/a", "block_index_few", buckets=2)
    qs = queries(spark, "violet ochre red", "teal teal umber", "mauve")
    assert ranked(index.topk(qs, 5)) == ranked(lexical.bm25_topk(docs(spark), qs, 5))
    none = block_index.build(docs(spark).limit(0), f"{tmp_path}/b", "block_index_none", buckets=2)
    assert none.topk(qs, 5).collect() == [] and none.n_docs == 0
    for name in ("few", "none"):
        spark.sql(f"DROP TABLE block_index_{name}")


def vectors(n, dim, seed, digits=1):
    # few digits, so that equal scores occur and ties must break by id
    return np.round(np.random.default_rng(seed).standard_normal((n, dim)), digits)


@pytest.mark.parametrize("path", ["broadcast", "grid"])
@pytest.mark.parametrize("string_ids", [False, True])
def test_search_matches_brute_force_with_ties(spark, monkeypatch, path, string_ids):
    lib, qs, k = vectors(300, 3, 1), vectors(9, 3, 2), 7
    ids = [f"d{i:03d}" for i in range(300)] if string_ids else list(range(300))
    ldf = spark.createDataFrame([(ids[i], "f" if i % 2 else "g", lib[i].tolist()) for i in range(300)],
                                f"doc_id {'string' if string_ids else 'bigint'}, field string, vec array<double>")
    qdf = spark.createDataFrame([(i, f, qs[i].tolist()) for i in range(9) for f in "fg"],
                                "instance_id int, field string, vec array<double>")
    if path == "grid":
        monkeypatch.setattr(dense, "GRID_BYTES", 1 << 9)
    out = dense.search(ldf.repartition(5), qdf, k, ["instance_id"],
                       query_bytes=0 if path == "grid" else dense.QUERY_BLOCK_BYTES).collect()
    got = {(r.instance_id, r.field, r["rank"]): (r.doc_id, r.score) for r in out}
    want = {}
    for i in range(9):
        for f in "fg":
            rows = [(-round(float(lib[j] @ qs[i]), 6) + 0.0, ids[j]) for j in range(300)
                    if ("f" if j % 2 else "g") == f]
            for r, (s, d) in enumerate(sorted(rows)[:k], 1):
                want[(i, f, r)] = (d, -s + 0.0)
    assert got == want


def test_search_small_blocks_keep_every_tie(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_CELLS", 8)
    ldf = spark.createDataFrame([(i, "x", [1.0, 0.0]) for i in range(50, 0, -1)],
                                "doc_id int, field string, vec array<double>").coalesce(1)
    qdf = spark.createDataFrame([(0, "x", [1.0, 0.0])], "instance_id int, field string, vec array<double>")
    out = dense.search(ldf, qdf, 4, ["instance_id"]).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [1, 2, 3, 4]


@pytest.mark.parametrize("chunks", [1, 5])
def test_grid_ranks_repeated_keys_and_many_queries(spark, monkeypatch, chunks):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 4)
    if chunks > 1:
        monkeypatch.setattr(dense, "GRID_BYTES", 1 << 11)
    lib, qs = vectors(60, 3, 5), vectors(40, 3, 6)
    lib[:20] = lib[20]
    ldf = spark.createDataFrame([(i, "f", v.tolist()) for i, v in enumerate(lib)], "doc_id bigint, field string, vec array<double>")
    # every key is asked twice, with vectors of its own
    rows = [(i // 2 if i > 1 else None, f, v.tolist()) for i, v in enumerate(qs) for f in ("f", "absent")]
    qdf = spark.createDataFrame(rows, "instance_id int, field string, vec array<double>")
    out = dense.search(ldf, qdf, 7, ["instance_id"], query_bytes=0)
    got = {(r.instance_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = [v for i, v in enumerate(qs) if (i // 2 if i > 1 else None) == key]
        hits = sorted((-round(float(x @ v), 6) + 0.0, j) for v in mine for j, x in enumerate(lib))
        for rank, (s, d) in enumerate(hits[:7], 1):
            want[key, rank] = (d, -s + 0.0)
    assert got == want


def test_grid_copies_of_the_library_do_not_grow_with_the_queries(spark):
    def copies(n):
        held, asked = {"f": n}, {"f": (n, n * 536)}
        return dense._grid_shape(spark, held, asked, 50)["f"]

    cores = spark.sparkContext.defaultParallelism
    assert copies(10_000) == (1, 2 * cores) and copies(100_000) == (1, 2 * cores)
    chunks, blocks = copies(600_000)
    assert chunks == -(-600_000 * 536 // dense.GRID_BYTES) and blocks <= 2 * cores


def test_search_of_many_queries_shuffles_no_library_and_no_hits(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(dense, "GRID_BYTES", 1 << 10)
    lib, qs = vectors(2000, 2, 7, 2), vectors(30, 2, 8, 2)
    ldf = spark.createDataFrame([(i, "f", v.tolist()) for i, v in enumerate(lib)], "doc_id bigint, field string, vec array<double>")
    # ranks beyond a query's depth may be left out
    qdf = spark.createDataFrame([(i, "f", v.tolist(), 3 if i % 2 else 9) for i, v in enumerate(qs)],
                                "instance_id int, field string, vec array<double>, depth int")
    out = dense.search(ldf.repartition(5), qdf, 7, ["instance_id"], query_bytes=0)
    got = {}
    for r in out.filter("rank <= if(instance_id % 2 = 1, 3, 7)").collect():
        got.setdefault(r.instance_id, []).append((r["rank"], r.score, r.doc_id))
    for i, v in enumerate(qs):
        best = sorted((-round(float(x @ v), 6) + 0.0, j) for j, x in enumerate(lib))[:3 if i % 2 else 7]
        assert sorted(got[i]) == [(n, -s + 0.0, j) for n, (s, j) in enumerate(best, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Exchange" not in plan and "Window" not in plan


def test_hits_are_ordered_by_query_score_and_id():
    rng = np.random.default_rng(3)
    q, d = rng.integers(0, 9, 4000), rng.integers(0, 50, 4000)
    for s in (np.round(rng.standard_normal(4000), 1), np.round(1e9 * rng.standard_normal(4000), 6), np.r_[np.inf, np.zeros(3999)]):
        order, want = dense._best_first(q, s, d, 6), np.lexsort((d, -s, q))
        assert all((x[order] == x[want]).all() for x in (q, s, d))


def test_scores_that_reach_the_bar_are_all_found():
    scores = np.round(np.random.default_rng(4).standard_normal((5, 2048)), 1).astype(np.float32)
    scores[1, 7] = scores[3, 2000] = np.nan
    for bar in (np.full(5, 2.5), np.array([3.0, -np.inf, 0.0, 9.0, 1.0])):
        want = np.nonzero(scores >= bar.astype(np.float32)[:, None])
        for finite in (False, not np.isnan(scores).any()):
            row, at = dense._reaching(scores, bar.astype(np.float32), finite)
            assert sorted(zip(row.tolist(), at.tolist())) == sorted(zip(*[x.tolist() for x in want]))
        scores = np.nan_to_num(scores)


def test_rrf_hand_example(spark):
    paths = spark.createDataFrame(
        [(7, "x", 4), (7, "x", 4), (7, "x", 4), (7, "y", 2), (7, "z", 1), (7, "z", 5)], "instance_id int, doc_id string, rank int")
    out = [(r.doc_id, round(r.score, 9)) for r in fusion.rrf(paths, k=1).orderBy("rank").collect()]
    assert out == [("z", round(1 / 2 + 1 / 6, 9)), ("x", 0.6), ("y", round(1 / 3, 9))]
    assert fusion.rrf(paths, k=1, top_k=2).count() == 2


def test_rrf_ties_by_id(spark):
    paths = spark.createDataFrame([(0, "b", 1), (0, "a", 1)], "instance_id int, doc_id string, rank int")
    assert [r.doc_id for r in fusion.rrf(paths).orderBy("rank").collect()] == ["a", "b"]


def test_rerank_is_subset_and_keeps_first_order_on_ties(spark):
    cand = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (0, "c", 3)], "instance_id int, doc_id string, rank int")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "instance_id int, vec array<double>")
    dv = spark.createDataFrame([("a", [0.5, 0.1]), ("b", [0.5, 0.9]), ("c", [0.9, 0.0]), ("z", [1.0, 0.0])],
                               "doc_id string, vec array<double>")
    out = fusion.rerank_cosine(cand, qv, dv, 2).orderBy("rank").collect()
    assert [r.doc_id for r in out] == ["c", "b"]


@pytest.mark.parametrize("chunked", [False, True])
def test_rerank_moves_no_vector_with_a_candidate(spark, monkeypatch, chunked):
    rng = np.random.default_rng(3)
    if chunked:
        monkeypatch.setattr(fusion, "CHUNK_BYTES", 1 << 10)
    vec = lambda n=4: rng.normal(size=n).round(3).tolist()
    docs = [(i, vec()) for i in range(40)] + [(7, vec()), (41, None), (42, [0.5, None, 0.1, 0.2]), (43, vec(3)), (None, vec())]
    asked = [(q, vec()) for q in range(12)] + [(3, vec()), (12, None), (None, vec())]
    cands = [(q, d, r) for q in [*range(13), None] for r, d in enumerate([7, q or 0, 41, 42, 43, None, 99, 20, 21], 1)]
    cdf = spark.createDataFrame(cands, "instance_id int, doc_id int, rank int")
    qdf = spark.createDataFrame(asked, "instance_id int, vec array<double>")
    ddf = spark.createDataFrame(docs, "doc_id int, vec array<double>")
    out = fusion.rerank_cosine(cdf, qdf, ddf, 50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("FlatMapCoGroupsInArrow" in plan) == chunked and plan.count("Join") == 1 + chunked, plan
    def dot(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b):
            return None
        return sum(x * y for x, y in zip(a, b))
    want = {}
    for q, d, r in cands:
        for v in [v for i, v in asked if i == q and q is not None]:
            for w in [w for i, w in docs if i == d and d is not None]:
                s = dot(v, w)
                want.setdefault(q, []).append((-1e9 if s is None else round(s, 6) + 0.0, -r, d, s is None))
    got = {}
    for row in sorted(out.collect(), key=lambda x: (x.instance_id, x["rank"])):
        got.setdefault(row.instance_id, []).append((row.doc_id, row.score))
    assert set(got) == set(want)
    for q, rows in want.items():
        order = sorted(rows, reverse=True)
        assert [d for d, _ in got[q]] == [d for _, _, d, _ in order]
        assert all((s is None) == none and (none or abs(s - x) < 2e-6) for (_, s), (x, _, _, none) in zip(got[q], order))


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def test_centroids_over_k_move_a_sample_once(spark):
    rng = np.random.default_rng(5)
    ks = (1, 2, 4)
    smp = spark.createDataFrame(
        [(q, i, rng.normal(size=3).tolist()) for q in range(6) for i in range(5) if (q + i) % 3 and q != 4] + [(2, 0, [1.0, 2.0, 3.0])] * 2,
        "instance_id int, sample_index int, vec array<double>")
    qv = spark.createDataFrame([(q, rng.normal(size=3).tolist()) for q in [*range(6), 1]], "instance_id int, vec array<double>")
    fields = smp.select("instance_id", "sample_index", F.explode(F.array(F.lit("meta"), F.lit("body"))).alias("field"), "vec").filter(
        "field = 'body' OR sample_index <> 1")
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    got = hypothesis.centroids_over_k(smp, qv, ks)
    want = [hypothesis.centroid_with_query(smp, qv, k).select(F.lit(k), "instance_id", "vec") for k in ks]
    assert rows(got.select("k_samples", "instance_id", "vec")) == sorted(x for w in want for x in rows(w))
    cols = ("instance_id", "field", "vec")
    got = hypothesis.field_centroids_over_k(fields, qv, ks).select("k_samples", *cols)
    want = [hypothesis.field_centroids(fields, qv, k).select(F.lit(k), *cols) for k in ks]
    assert rows(got) == sorted(x for w in want for x in rows(w))
    # the rows that move are samples, not samples of every K
    plan = hypothesis.centroids_over_k(smp, qv, ks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.index("Join"):], plan


def test_queries_that_are_alike_at_some_k_are_one_row(spark):
    rng = np.random.default_rng(6)
    ks = (1, 2, 4)
    smp = spark.createDataFrame([(q, i, rng.normal(size=3).tolist()) for q in range(6) for i in (0, 3)[:q % 3]],
                                "instance_id int, sample_index int, vec array<double>")
    qv = spark.createDataFrame([(q, rng.normal(size=3).tolist()) for q in [*range(6), 1]], "instance_id int, vec array<double>")
    whole = hypothesis.centroids_over_k(smp, qv, ks)
    rows = lambda df: sorted(str(tuple(r)) for r in df.select("k_samples", "instance_id", "vec").collect())
    for some in (hypothesis.centroids_over_k(smp, qv, ks, shared=True),
                 hypothesis.shared_over_k(whole.withColumn("field", F.lit("f")), ["instance_id"], ks)):
        assert rows(some.withColumn("k_samples", F.explode(hypothesis.ks_of(F.col("k_class"), ks)))) == rows(whole)
        # queries with no or one sample have one row, those with two samples have two
        assert some.count() == 2 + 3 + 4


def test_runs_at_every_k_do_not_search_twice(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist(), int(rng.integers(0, 10))) for i, v in enumerate(rng.standard_normal((60, 64)))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    val = {tuple(r) for r in ablation_setup.k_validation(spark, sf).collect()}
    assert ablation_setup.k_router(spark, sf).count() == 5 * len({d for d, *_ in val})
    assert not os.path.exists(stage_path(spark, sf, "vector_run"))
    assert val == {tuple(r) for r in eval_setup.validation(spark, sf).collect()}


def test_centroids(spark):
    smp = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.0, -5.0])],
        "instance_id int, sample_index int, vec array<double>")
    qv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "instance_id int, vec array<double>")
    out = {r.instance_id: r for r in hypothesis.centroid_with_query(smp, qv, 2).collect()}
    assert np.allclose(out[1].vec, unit(np.array([2.0, 1.0]) / 3)) and out[1].n_samples == 2
    assert np.allclose(out[2].vec, [0.6, 0.8]) and out[2].n_samples == 0


def test_field_centroids_weigh_query_by_all_samples(spark):
    # three samples, only one has a meta text: the query still weighs 1 of 4
    rows = [(1, 0, "meta", [1.0, 0.0]), (1, 0, "body", [0.0, 2.0]), (1, 1, "body", [2.0, 0.0]),
            (1, 2, "code", [0.0, 0.0]), (2, 0, "body", [3.0, 0.0])]
    smp = spark.createDataFrame(rows, "instance_id int, sample_index int, field string, vec array<double>")
    anchor = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])],
                                   "instance_id int, vec array<double>")
    out = {(r.instance_id, r.field): r.vec for r in hypothesis.field_centroids(smp, anchor).collect()}
    assert np.allclose(out[(1, "meta")], unit(np.array([3.0, 1.0]) / 4))
    assert np.allclose(out[(1, "body")], unit(np.array([1.0, 1.0])))
    assert out[(1, "code")] == [0.0, 0.0]
    assert np.allclose(out[(2, "meta")], [0.0, 1.0]) and (3, "meta") not in out


def test_agreement_equals_pairwise_mean(spark):
    vs = [unit(v) for v in vectors(4, 5, 3, 6)]
    smp = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vs)] + [(2, 0, [1.0] * 5)],
                                "instance_id int, sample_index int, vec array<double>")
    out = {r.instance_id: r.agreement for r in hypothesis.agreement(smp).collect()}
    pairs = [vs[i] @ vs[j] for i in range(4) for j in range(i)]
    assert out[1] == pytest.approx(np.mean(pairs)) and out[2] == 1.0


def test_blank_samples_count_and_keep_their_query(spark):
    fields = spark.createDataFrame([(1, 0, "meta", [1.0, 0.0])], "instance_id int, sample_index int, field string, vec array<double>")
    drawn = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "instance_id int, sample_index int")
    anchors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "instance_id int, vec array<double>")
    out = {r.instance_id: r.vec for r in hypothesis.field_centroids(fields, anchors, drawn=drawn).collect()}
    assert set(out) == {1, 2} and out[2] == [0.0, 1.0]
    assert out[1] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])


def clustered_vectors(n, groups, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, dim))
    return np.round(middle[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim)), 3)


def top_rows(spark, lib, asked, k):
    """Both searches over the same rows, and the products of the clustered one."""
    l = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(lib)], "doc_id bigint, vec array<double>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "instance_id bigint, vec array<double>").repartition(3)
    built = clustered.build(l, clusters=40)
    got, routed = built.steps(q, k, ["instance_id"])
    field = lambda df: df.withColumn("field", F.lit("full"))
    want = dense.search(field(l), field(q), k, ("instance_id",))
    per_chunk = built.vectors.groupBy("cluster", "chunk").count()
    products = sum(r.join(per_chunk, ["cluster", "chunk"]).agg(F.sum("count")).first()[0] or 0 for r in routed)
    return ranked(got), ranked(want), products


@pytest.mark.parametrize("chunk", [8192, 37])
def test_clustered_search_is_exact_and_leaves_clusters_out(spark, monkeypatch, chunk):
    monkeypatch.setattr(clustered, "CHUNK", chunk)
    lib = clustered_vectors(3000, 40, 16, 1)
    asked = clustered_vectors(60, 40, 16, 1)
    got, want, products = top_rows(spark, lib, asked, 10)
    assert got == want and len(got) == 600
    assert products < len(lib) * len(asked) / 3, products / (len(lib) * len(asked))


def test_clustered_search_copies_no_query_to_clusters(spark):
    lib, asked = vectors(500, 6, 5), vectors(40, 6, 6)
    frame = lambda name, rows: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} bigint, vec array<double>")
    got, steps = clustered.build(frame("doc_id", lib), clusters=20).steps(frame("instance_id", asked), 10, ["instance_id"])
    met = sum(s.count() for s in steps)
    assert met > 5 * len(asked) and all("vec" not in s.columns for s in steps)
    # only hits are shuffled, by query; queries and vectors meet where the library is read
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    assert got.count() == 400


def test_clustered_search_without_structure(spark, monkeypatch):
    monkeypatch.setattr(clustered, "QUERY_BLOCK", 7)
    lib, asked = vectors(300, 6, 3), vectors(25, 6, 4)
    lib[10:60] = lib[9]
    got, want, _ = top_rows(spark, lib, asked, 30)
    assert got == want
    # fewer documents than asked for, none at all, and queries without a vector
    got, want, _ = top_rows(spark, lib[:5], asked, 30)
    assert got == want and len(got) == 125
    none = spark.createDataFrame([], "doc_id bigint, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "instance_id bigint, vec array<double>")
    assert clustered.build(none).search(q, 5, ["instance_id"]).collect() == []
    one = spark.createDataFrame([(4, [0.5, 0.5])], "doc_id bigint, vec array<double>")
    assert [tuple(r) for r in clustered.build(one).search(q, 5, ["instance_id"]).collect()] == [(1, 4, 1.5, 1)]


def test_retrievers_by_name(spark):
    assert {"bm25", "dense", "hybrid"} <= set(retrievers.names())
    with pytest.raises(KeyError, match="bm25"):
        retrievers.named("none")
    with pytest.raises(ValueError):
        retrievers.register("bm25")(retrievers.Bm25)
    qs = queries(spark, "blue violet", "teal")
    for name in ("bm25", "dense", "hybrid"):
        got = ranked(retrievers.named(name).index(docs(spark)).topk(qs, 2))
        assert got[0, 1][0] == "s2" and got[1, 1][0] == "s4" and max(r for _, r in got) <= 2
    want = ranked(lexical.bm25_topk(docs(spark), qs, 3))
    assert ranked(retrievers.named("bm25").index(docs(spark)).topk(qs, 3)) == want


def test_blocks_asked_for_by_nobody_do_not_move(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} v{i}") for i in range(80)], "doc_id bigint, text string")
    index = block_index.build(corpus, str(tmp_path / "index"), "bm25_not_moved", block=4)
    weights = spark.createDataFrame([(0, "w1", 1.0, 2), (0, "v3", 1.0, 0)], "instance_id int, token string, w double, bits int")
    found = spark.createDataFrame([(0, 1), (0, 3)], "instance_id int, doc_id bigint")
    read = index.second_read(index.blocks, weights, found)
    physical = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
    assert read.filter("token = 'v3'").count() == 1
    spark.sql("DROP TABLE bm25_not_moved")


def test_buckets_grow_with_the_postings(spark, monkeypatch):
    tokens = spark.createDataFrame([("a", 10_000_000), ("b", 90_000_000)], "token string, df bigint")
    assert block_index._buckets(tokens) == -(-100_000_000 // block_index.BUCKET_POSTINGS)
    assert block_index._buckets(tokens.limit(0)) == 8
