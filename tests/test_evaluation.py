import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from imagora.operators import gating, metrics, packs, ranking, routing, splits


def run_of(spark, lists, **const):
    rows = [(i, r, d) for i, docs in lists.items() for r, d in enumerate(docs, 1)]
    df = spark.createDataFrame(rows, "instance_id string, rank int, doc_id string").withColumn("score", F.lit(1.0))
    for k, v in const.items():
        df = df.withColumn(k, F.lit(v))
    return df


def gold_of(spark, gold):
    return spark.createDataFrame([(i, d) for i, ds in gold.items() for d in ds],
                                 "instance_id string, doc_id string")


def test_recall_and_ndcg_by_hand(spark):
    run = run_of(spark, {"a": ["g1", "x", "y"], "b": ["x", "g", "y"], "c": ["x", "y", "z"]}, domain="d")
    gold = gold_of(spark, {"a": ["g1", "g2"], "b": ["g"], "c": ["g"], "unused": ["g"]})
    out = {r.instance_id: r for r in metrics.per_instance_wide(run, gold, ["domain"], (1, 3, 10)).collect()}
    assert out["a"]["Recall@1"] == out["a"]["Recall@3"] == 0.5
    assert out["a"]["nDCG@1"] == 1.0
    assert out["a"]["nDCG@10"] == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert out["b"]["nDCG@10"] == pytest.approx(1 / math.log2(3)) and out["b"]["Recall@1"] == 0.0
    assert out["c"]["nDCG@10"] == 0.0 and set(out) == {"a", "b", "c"}


def test_instances_without_hits_count_as_zero(spark):
    run = run_of(spark, {"a": ["g"]}, domain="d")
    wanted = spark.createDataFrame([("d", "a"), ("d", "b")], "domain string, instance_id string")
    rows = metrics.mean_metrics(run, gold_of(spark, {"a": ["g"], "b": ["g"]}), ["domain"], (1,), wanted).collect()
    assert {(r.metric, r.n, r.value) for r in rows} == {("Recall@1", 2, 0.5), ("nDCG@1", 2, 0.5)}
    assert [r.instance_id for r in metrics.missing_instances(run, wanted, ["domain"]).collect()] == ["b"]


def test_micro_macro(spark):
    cells = spark.createDataFrame([("x", 1, 1.0), ("y", 3, 0.0)], "domain string, n bigint, value double") \
        .withColumn("metric", F.lit("m"))
    out = {r.domain: (r.n, r.value) for r in metrics.micro_macro(cells, ["metric"]).collect()}
    assert out == {metrics.MICRO: (4, 0.25), metrics.MACRO: (2, 0.5)}


def test_hashed_rank_equals_full_sort(spark):
    import hashlib
    ids = [(g, i) for g in ("hot", "cold") for i in range(400 if g == "hot" else 7)]
    df = spark.createDataFrame(ids, "domain string, instance_id int")
    got = {(r.domain, r.instance_id): (r.draw_rank, r.group_n)
           for r in ranking.hashed_rank(df, ["domain"], ["instance_id"], 3).collect()}
    for g in ("hot", "cold"):
        order = sorted((i for d, i in ids if d == g),
                       key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
        assert [got[(g, i)] for i in order] == [(r, len(order)) for r in range(len(order))]


def test_split_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", 1)], "domain string, instance_id int")
    n = {r.domain: r.n for r in splits.validation_split(df).filter("is_validation").groupBy("domain")
         .agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 4, "b": 1}


def test_compat_split_replays_python_draw(spark):
    ids = [f"i{n:03d}" for n in range(41)]
    df = spark.createDataFrame([("a", i) for i in reversed(ids)], "domain string, instance_id string")
    got = {r.instance_id for r in splits.validation_split_compat(df).filter("is_validation").collect()}
    assert got == set(random.Random(0).sample(sorted(ids), 8))


def score_rows(spark, table):
    rows = [("d", v, f"i{n}", x) for v, xs in table.items() for n, x in enumerate(xs)]
    return spark.createDataFrame(rows, "domain string, variant string, instance_id string, value double")


def all_validation(spark, n):
    return spark.createDataFrame([("d", f"i{k}", True) for k in range(n)],
                                 "domain string, instance_id string, is_validation boolean")


def test_router_picks_best_and_breaks_ties_by_order(spark):
    s = score_rows(spark, {"hypo_sentence": [1.0, 0.0], "hypo_passage": [0.0, 1.0], "fused": [0.2, 0.2]})
    val = all_validation(spark, 2)
    assert routing.route(s, val, routing.LOOSE_ORDER).first().pick == "hypo_passage"
    assert routing.route(s, val, routing.STRICT_ORDER).first().pick == "hypo_sentence"


def test_router_degenerate_takes_fallback_if_measured(spark):
    val = all_validation(spark, 1)
    r = routing.route(score_rows(spark, {"fused": [0.0], "hypo_skill": [0.0]}), val).first()
    assert (r.pick, r.degenerate) == ("hypo_skill", True)
    r = routing.route(score_rows(spark, {"two_stage": [0.0], "fused": [0.0]}), val).first()
    assert (r.pick, r.degenerate) == ("fused", True)


def test_routed_run_is_the_winner(spark):
    run = run_of(spark, {"a": ["x", "y"]}, domain="d", variant="fused").unionByName(
        run_of(spark, {"a": ["y", "x"]}, domain="d", variant="hypo_skill"))
    router = spark.createDataFrame([("d", "hypo_skill")], "domain string, pick string")
    routed = routing.routed_run(run, router)
    assert {(r["rank"], r.doc_id) for r in routed.collect()} == {(1, "y"), (2, "x")}
    cols = ["instance_id", "rank", "doc_id"]
    assert routing.run_difference(routed, run.filter("variant = 'hypo_skill'"), cols).count() == 0
    assert routing.run_difference(routed, run.filter("variant = 'fused'"), cols).count() == 4


def brute_tau(pairs, p_min):
    best, pos = None, 0
    for i, (v, p) in enumerate(sorted(pairs), 1):
        pos += p
        if pos / i >= p_min:
            best = v
    return best


def taus(spark, groups, p_min):
    rows = [(g, float(v), bool(p)) for g, ps in groups.items() for v, p in ps]
    df = spark.createDataFrame(rows, "g int, v double, p boolean")
    return {r.g: r.tau for r in gating.pick_tau(df, ["g"], "v", "p", p_min).collect()}


def test_pick_tau_examples(spark):
    groups = {3: [(.5, 1), (.5, 0), (.7, 1), (.7, 1)], 4: [(.6, 1)], 5: [(.2, 0), (.2, 1), (.9, 1)]}
    assert taus(spark, groups, 0.75) == {g: brute_tau(ps, 0.75) for g, ps in groups.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=1, max_size=40),
                min_size=1, max_size=8), st.sampled_from([0.3, 0.5, 0.9]))
def test_pick_tau_equals_row_by_row(spark, groups, p_min):
    named = {i: [(v / 10, p) for v, p in g] for i, g in enumerate(groups)}
    assert taus(spark, named, p_min) == {i: brute_tau(g, p_min) for i, g in named.items()}


def test_gate_blocks_skips_keeps_and_passes_unknown(spark):
    sig = spark.createDataFrame(
        [("d", "a", .11, .3, True), ("d", "b", .66, .21, False), ("d", "c", .9, .4, False), ("d", "e", .35, .25, False)],
        "domain string, instance_id string, s1 double, s2 double, top1_wrong boolean")
    tau = spark.createDataFrame([("d", .35, .25)], "domain string, tau1 double, tau2 double")
    dec = gating.decide(sig, tau)
    assert {r.instance_id: r.decision for r in dec.collect()} == {
        "a": "blocked", "b": "skipped", "c": "kept", "e": "kept"}
    run = run_of(spark, {i: ["x"] for i in "abcez"}, domain="d")
    assert {r.instance_id for r in gating.apply_gate(run, dec).collect()} == {"c", "e", "z"}
    c = gating.gate_counts(dec).first()
    assert (c.blocked, c.skipped, c.kept, c.block_precision) == (1, 1, 2, 1.0)
    off = spark.createDataFrame([("d", None, None)], "domain string, tau1 double, tau2 double")
    assert {r.decision for r in gating.decide(sig, off).collect()} == {"kept"}


def test_novelty(spark):
    df = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.7, 0.0]]), (2, [[1.0]], []),
                                (3, None, [[1.0]])], "i int, c array<array<double>>, h array<array<double>>")
    out = {r.i: r.s for r in df.select("i", gating.novelty(F.col("c"), F.col("h")).alias("s")).collect()}
    assert out == {1: 0.5, 2: 1.0, 3: 1.0}


def test_difficulty_threshold_equals_scan(spark):
    rnd = random.Random(4)
    rows = [("d", f"i{n}", True, round(rnd.uniform(-0.2, 0.9), 6), rnd.random(), rnd.random()) for n in range(60)]
    df = spark.createDataFrame(rows, "domain string, instance_id string, is_validation boolean, "
                                     "agreement double, single double, fusion double")
    got = routing.difficulty_thresholds(df, "single", "fusion").first()
    micro = {r[1]: round(r[3] * 1e6) for r in rows}
    cands = sorted({(m + 500) // 1000 for m in micro.values()})
    def mean(t):
        return round(sum(r[4] if micro[r[1]] // 1000 >= t else r[5] for r in rows) / len(rows), 10)
    best = max(cands, key=lambda t: (mean(t), -t))
    assert got.tau == best / 1000 and got.val_mean == pytest.approx(mean(best))


def test_loading_records(spark):
    dec = spark.createDataFrame([("d", "a", "x", "kept"), ("d", "b", "y", "blocked")],
                                "domain string, instance_id string, top1 string, decision string")
    gold = gold_of(spark, {"a": ["x"], "b": ["z"]})
    recs = packs.loading_records(packs.loading_arms(dec, gold), gold).collect()
    hit = {(r.arm, r.instance_id): r.hit for r in recs}
    assert hit == {("bare", "a"): None, ("bare", "b"): None, ("always", "a"): 1, ("always", "b"): 0,
                   ("gated", "a"): 1, ("gated", "b"): None, ("oracle", "a"): 1, ("oracle", "b"): 1}


def test_leaderboard_needs_every_cell(spark):
    rows = [("m1", "x", "full", .4), ("m2", "x", "full", .6), ("m1", "x", "part", .9)]
    df = spark.createDataFrame(rows, "model string, domain string, method string, value double")
    assert [(r.method, r["rank"]) for r in metrics.leaderboard(df).collect()] == [("full", 1)]
