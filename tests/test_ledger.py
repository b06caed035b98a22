import gzip
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from imagora.functions import prompts
from imagora.operators import checks, cost, encode, resample, samples
from imagora.sources import json_files


# ------------------------------------------------------------------ resampling

def diffs(spark, groups):
    rows = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, instance_id int, v double")


def md5_int(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def brute_means(name, values, replicates, seed):
    order = sorted(range(len(values)), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    v = [values[i] for i in order]
    n = len(v)
    mask = (1 << 31) - 1

    def mix(word):
        word = (word * 73244475) & mask
        word ^= word >> 15
        word = (word * 668265261) & mask
        return word ^ (word >> 13)

    word = md5_int(f"{seed}:{name}") & mask
    return [sum(v[mix(mix(i) ^ mix((word + b) & mask)) % n] for i in range(n)) / n for b in range(replicates)]


@pytest.mark.parametrize("small", [True, False])
def test_hashed_means_draw_by_draw(spark, monkeypatch, small):
    monkeypatch.setattr(resample.sizing, "fits_broadcast", lambda df: small)
    groups = {"x": [0, 1, 1, -1, 0.5], "y": [2, 3]}
    got = {(r.g, r.replicate): r["mean"] for r in resample.hashed_means(
        diffs(spark, groups), ["g"], "v", 6, 9).collect()}
    for g, vs in groups.items():
        assert [got[(g, b)] for b in range(6)] == pytest.approx(brute_means(g, vs, 6, 9))


def test_hashed_means_have_bootstrap_moments(spark):
    values = np.round(np.random.default_rng(1).standard_normal(50), 1)
    means = np.array([r["mean"] for r in resample.hashed_means(diffs(spark, {"x": values}), ["g"], "v", 4000).collect()])
    assert len(means) == 4000
    assert means.mean() == pytest.approx(values.mean(), abs=0.01)
    assert means.std() == pytest.approx(values.std() / np.sqrt(50), rel=0.05)


@pytest.mark.parametrize("chunk", [1 << 16, 3])
def test_multinomial_means_have_bootstrap_moments(spark, chunk):
    rng = np.random.default_rng(0)
    values = np.round(rng.standard_normal(60), 1)
    df = diffs(spark, {"x": values})
    means = np.array([r["mean"] for r in resample.multinomial_means(
        df, ["g"], "v", 3000, 1, chunk).collect()])
    assert len(means) == 3000
    se = values.std() / np.sqrt(60)
    assert abs(means.mean() - values.mean()) < 5 * se / np.sqrt(3000)
    assert means.std() == pytest.approx(se, rel=0.06)
    again = [r["mean"] for r in resample.multinomial_means(df, ["g"], "v", 3000, 1, chunk).collect()]
    assert sorted(again) == sorted(means.tolist())


def test_p_value_conventions(spark):
    df = spark.createDataFrame([("g", b, m) for b, m in enumerate([0.0, 0.0, 0.0, 1.0])],
                               "g string, replicate int, mean double")
    p = {n: resample.summarize(df, ["g"], n).first().p_two_sided for n in resample.P_VALUES}
    assert p == {"uncapped": 1.5, "capped": 1.0, "one_count": 0.5}


def test_macro_reports_distribution_mean(spark):
    df = diffs(spark, {"x": [0, 1], "y": [1, 1, 1]}).withColumnRenamed("g", "s").select(
        F.lit("c").alias("c"), "s", "instance_id", F.col("v").alias("a"), F.lit(0.0).alias("b"))
    r = resample.macro(df, ["c"], "s", 40).first()
    assert r.n_strata == 2 and r.n_instances == 5 and r.mean_a == 0.75
    assert r.ci_low <= r.difference <= r.ci_high and 0.5 <= r.difference <= 1.0


def test_hierarchical_constant_matrix(spark):
    rows = [("c", m, d, 3.0, 1.0) for m in "ab" for d in "xyz"]
    df = spark.createDataFrame(rows, "c string, m string, d string, a double, b double")
    r = resample.hierarchical(df, ["c"], "m", "d", 20).first()
    assert (r.n_outer, r.n_inner, r.difference, r.ci_low, r.ci_high, r.p_two_sided) == (2, 3, 2.0, 2.0, 2.0, 0.0)


def test_named_seed_depends_on_name_only():
    assert resample.named_seed("a") != resample.named_seed("b")
    assert resample.named_seed("a", 5) == resample.named_seed("a") ^ 5


# ------------------------------------------------------------------ samples

def query_table(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


def test_grid_is_per_distinct_query(spark):
    g = samples.required_grid(query_table(spark, "a", "a", "b"), 2, "m")
    assert g.count() == 2 * 3 * 2 and g.select("sample_key").distinct().count() == 12
    assert {r.prompt for r in g.filter("template = 'passage' AND query = 'a'").collect()} == {
        prompts.TEMPLATES["passage"].replace("{q}", "a")}


def test_compat_key_is_json_digest(spark):
    df = spark.createDataFrame([("m|x", 0.7, "tpl é", "q \"1\"", 3)],
                               "a string, b double, c string, d string, e int")
    got = df.select(samples.sample_key_compat(*[F.col(c) for c in "abcde"]).alias("k")).first().k
    assert got == hashlib.sha256(json.dumps(["m|x", 0.7, "tpl é", "q \"1\"", 3]).encode()).hexdigest()


def test_generation_skips_stored_retries_and_reports_failures(spark, tmp_path):
    grid = samples.required_grid(query_table(spark, "ok", "flaky", "bad"), 1, "m",
                                 templates={"t": "Task: {q}"}).coalesce(1)
    stored = grid.filter("query = 'ok'").select("sample_key", F.lit("kept").alias("text"))
    mark = tmp_path / "seen"

    def client(frame: pd.DataFrame) -> pd.Series:
        assert not frame["prompt"].str.contains("ok").any()
        if frame["prompt"].str.contains("bad").any():
            raise RuntimeError("no")
        if not mark.exists():
            mark.write_text("x")
            raise RuntimeError("first time")
        return frame["prompt"].str.upper()

    out = {r.query: (r.status, r.text) for r in samples.generate_missing(grid, stored, client).collect()}
    assert out == {"flaky": ("generated", "TASK: FLAKY"), "bad": ("failed", None)}
    nothing = samples.generate_missing(grid, grid.select("sample_key"), client)
    assert nothing.count() == 0


def sample_rows(spark, rows):
    return spark.createDataFrame(rows, "instance_id int, template string, sample_index int, text string")


def test_chained_digests_prove_every_prefix(spark):
    pack = lambda rows: samples.prefix_pack(sample_rows(spark, rows), 10)
    digests = lambda rows: {(r.instance_id, r.k_samples): r.digest for r in samples.chained_digests(pack(rows), [1, 2, 4]).collect()}
    a = digests([(1, "t", i, f"x{i}") for i in range(4)] + [(2, "t", 0, "ab"), (2, "t", 1, "c")])
    b = digests([(1, "t", 0, "x0"), (1, "t", 1, "x1"), (1, "t", 2, "y"), (1, "t", 3, "x3"), (2, "t", 0, "a"), (2, "t", 1, "bc")])
    assert [a[1, k] == b[1, k] for k in (1, 2, 4)] == [True, True, False]
    # borders cannot shift, and a short pack ends with its last sample
    assert not any(a[2, k] == b[2, k] for k in (1, 2, 4)) and a[2, 2] == a[2, 4] != a[2, 1]
    same = samples.chained_digests(pack([(1, "t", 0, "x"), (2, "t", 0, None)]), [1])
    more = samples.chained_digests(pack([(1, "t", 0, "x"), (2, "t", 0, ""), (3, "t", 0, "z")]), [1])
    assert [tuple(r) for r in samples.prefix_proofs(same, more).collect()] == [("t", 1, 1, 1, 0, 1)]


def test_prefix_pack_and_check(spark):
    big = samples.prefix_pack(sample_rows(spark, [(1, "t", i, f"x{i}") for i in range(4)]
                                          + [(2, "t", 0, "y"), (2, "t", 1, " ")]), 4)
    assert {(r.instance_id, r.n, r.usable) for r in big.collect()} == {(1, 4, True), (2, 2, False)}
    small = samples.prefix_pack(sample_rows(spark, [(1, "t", 0, "x0"), (1, "t", 1, "x1")]), 2)
    assert [(r.instance_id, r.problem) for r in samples.prefix_violations(big, small, 2).collect()] == [(2, "absent")]
    swapped = samples.prefix_pack(sample_rows(spark, [(1, "t", 0, "x1"), (1, "t", 1, "x0"), (2, "t", 0, "y"), (2, "t", 1, " ")]), 2)
    assert [(r.instance_id, r.problem) for r in samples.prefix_violations(big, swapped, 2).collect()] == [(1, "differs")]


def test_audit_counts(spark):
    grid = samples.required_grid(query_table(spark, "a", "b", "c", "d"), 1, "m", templates={"t": "{q}"})
    texts = F.when(F.col("query") == "a", F.lit("fine")).when(F.col("query") == "b", F.lit(" \n"))
    stored = grid.filter("query <> 'd'").select("sample_key", texts.alias("text"))
    r = samples.audit(grid, stored).first()
    assert (r.expected, r.present, r.missing, r.empty, r.unreadable, r.complete) == (4, 1, 1, 1, 1, False)
    assert samples.audit_errors(grid, stored, 2).count() == 2


def test_duplicate_query_report_finds_differing_sets(spark):
    rows = [("q", "t", 1, 0, "a"), ("q", "t", 1, 1, "b"), ("q", "t", 2, 0, "a"), ("q", "t", 2, 1, "b"),
            ("r", "t", 3, 0, "a"), ("r", "t", 4, 0, "c")]
    df = spark.createDataFrame(rows, "query string, template string, instance_id int, sample_index int, text string")
    out = {r.query: (r.instances, r.variants) for r in samples.duplicate_query_report(df).collect()}
    assert out == {"q": (2, 1), "r": (2, 2)}


def test_hashed_encoder_is_unit_and_zero_for_blank(spark):
    df = spark.createDataFrame([("a b a",), (" ",)], "t string")
    v = [r.v for r in df.select(encode.encode_text(F.col("t")).alias("v")).collect()]
    assert np.linalg.norm(v[0]) == pytest.approx(1.0) and np.linalg.norm(v[1]) == 0.0 and len(v[0]) == 64


def test_injected_encoder(spark):
    df = spark.createDataFrame([("a b",), ("a",)], "t string")
    enc = lambda lists: np.array([[len(x), 0.0] for x in lists])
    assert [r.v for r in df.select(encode.encode_text(F.col("t"), enc).alias("v")).collect()] == [[1.0, 0.0]] * 2


# ------------------------------------------------------------------ cost

def test_token_cost(spark):
    t = spark.createDataFrame([(2, 38, 76, 4)], "queries bigint, prompt_chars bigint, output_chars bigint, generations bigint")
    r = cost.token_cost(t, 2).first()
    assert r.input_tokens == pytest.approx(20) and r.output_tokens == pytest.approx(20)
    assert r.total_per_query == pytest.approx(20) and r.output_per_generation == pytest.approx(5)


def test_timing_statuses(spark):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "m string")
    st = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0)], "m string, seconds double")
    out = {r.m: (r.status, r.total_seconds) for r in cost.timing_rollup(want, st, ["m"]).collect()}
    assert out == {"a": ("recorded", 3.0), "b": ("invalid", None), "c": ("unavailable", None)}


# ------------------------------------------------------------------ checks

def test_table_digest_ignores_order_and_sees_changes(spark):
    rows = [("g", i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    d = lambda x: checks.table_digest(x, ["g"], ["i", "t"]).first().digest
    assert d(df) == d(df.orderBy(F.desc("i")).repartition(7))
    assert d(df) != d(df.withColumn("t", F.when(F.col("i") == 3, F.lit("z")).otherwise(F.col("t"))))
    assert d(df) != d(df.union(df.limit(1)))


def test_validate_run(spark):
    run = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x"), ("c", 3, "y")],
                                "instance_id string, rank int, doc_id string").withColumn("k", F.lit(1))
    want = spark.createDataFrame([("a", 1), ("c", 1), ("z", 1)], "instance_id string, k int")
    out = {(r.instance_id, r.problem) for r in checks.validate_run(run, want, ["k"], depth=2).collect()}
    assert out == {("a", "duplicate_document"), ("b", "extra"), ("b", "length"), ("c", "ranks"), ("z", "missing")}


def test_rules_and_drift(spark):
    df = spark.createDataFrame([(1, " ", float("nan")), (2, "ok", 1.0), (3, None, float("inf"))], "k int, s string, v double")
    rules = {"text": ("s", checks.is_text(F.col("s"))), "finite": ("v", checks.is_finite(F.col("v")))}
    out = {(r.k, r.rule) for r in checks.violations(df, ["k"], rules).collect()}
    assert out == {(1, "text"), (1, "finite"), (3, "text"), (3, "finite")}
    a = spark.createDataFrame([("m", 0.5), ("n", 0.5), ("o", 0.1)], "metric string, value double")
    b = spark.createDataFrame([("m", 0.5 + 1e-12), ("n", 0.51)], "metric string, value double")
    got = {r.metric: r.status for r in checks.metric_drift(a, b, ["metric"]).collect()}
    assert got == {"m": "ok", "n": "drift", "o": "missing"}
    loose = {r.metric: r.status for r in checks.metric_drift(a, b, ["metric"], checks.DRIFT_LOOSE).collect()}
    assert loose["n"] == "ok"


def test_gaps_reconcile_restamp_stamp(spark, tmp_path):
    want = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    have = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a")], "k int, v string")
    assert {(r.k, r.problem) for r in checks.matrix_gaps(want, have, ["k", "v"]).collect()} == {
        (1, "duplicate"), (2, "missing"), (3, "extra")}
    m = spark.createDataFrame([("x", 1, "h")], "d string, n int, hash string")
    n = spark.createDataFrame([("x", 2, "h")], "d string, n int, hash string")
    assert [(r.field, r.recorded, r.found) for r in checks.reconcile(m, n, ["d"], ["n", "hash"]).collect()] == [("n", "1", "2")]
    meta = spark.createDataFrame([("old",), ("new",), ("odd",)], "source_revision string")
    out = {r.action: r.source_revision for r in checks.restamp(meta, "old", "new").collect()}
    assert out == {"migrated": "new", "already_current": "new", "rejected": "odd"}
    stamped = checks.stamp(meta, {"m": F.lit("x")}, {"h": F.lit("y")})
    with pytest.raises(ValueError):
        checks.stamp(stamped, {"m": F.lit("x")}, {"h": F.lit("y")})
    checks.write_new(meta, str(tmp_path / "out"))
    with pytest.raises(Exception):
        checks.write_new(meta, str(tmp_path / "out"))


# ------------------------------------------------------------------ files

PAYLOAD = {"metadata": {"dataset": "d", "top_k": 2}, "metrics": {"Recall@1": 0.5},
           "results": [{"instance_id": "i1", "gold_skill_ids": ["g"],
                        "retrieved": [{"skill_id": "g", "score": 2.0}, {"skill_id": "x", "score": 1.0}]},
                       {"instance_id": "i2", "gold_skill_ids": [], "retrieved": []}]}


def test_payload_scan(spark, tmp_path):
    p = tmp_path / "d-two_stage.json"
    p.write_text(json.dumps(PAYLOAD, indent=1))
    records, meta, values = json_files.read_run_payload(spark, str(p))
    hits = json_files.explode_hits(records, ["file"]).orderBy("rank").collect()
    assert [(h.instance_id, h["rank"], h.doc_id, h.score) for h in hits] == [("i1", 1, "g", 2.0), ("i1", 2, "x", 1.0)]
    assert {(r.key, r.value) for r in meta.collect()} == {("dataset", "d"), ("top_k", "2")}
    assert values.first().value == 0.5
    assert json_files.explode_gold(records).collect()[0].doc_id == "g"


def test_named_runs_take_identity_from_file_names(spark, tmp_path):
    for n in ("alpha-two_stage.json", "alpha-always-r.json", "alpha-bare.eval.json"):
        (tmp_path / n).write_text(json.dumps(PAYLOAD))
    got = {(r.dataset, r.variant) for r in json_files.read_named_runs(spark, str(tmp_path)).collect()}
    assert got == {("alpha", "two_stage"), ("alpha", "always-r")}


def test_corpus_scan_with_fallback(spark, tmp_path):
    p = tmp_path / "corpus.json"
    p.write_text(json.dumps([{"skill_id": "a", "name": "N", "description": "D", "content": "text\n```py\nz\n```"}], indent=2))
    index = spark.createDataFrame([("a", "full a"), ("b", "t" * 300)], "doc_id string, text string")
    out = {r.doc_id: r for r in json_files.corpus_fields(index, json_files.read_corpus(spark, str(p))).collect()}
    assert (out["a"].meta, out["a"].code, out["a"].has_record) == ("N. D", "z", True)
    assert (out["b"].meta, out["b"].body, out["b"].code, out["b"].has_record) == ("t" * 200, "t" * 300, "", False)


def test_instances_keep_annotated_rows(spark, tmp_path):
    rows = [{"instance_id": "1", "dataset": "d", "question": "q", "skill_annotations": ["s"]},
            {"instance_id": "1", "dataset": "e", "question": "q", "skill_annotations": ["s"]},
            {"instance_id": "2", "dataset": "d", "question": "q", "skill_annotations": []}]
    p = tmp_path / "i.json"
    p.write_text(json.dumps(rows))
    df = json_files.read_instances(spark, str(p))
    assert df.count() == 2
    assert {(r.instance_id, r.problem) for r in json_files.instance_problems(df, "d").collect()} == {
        ("1", "duplicate"), ("1", "domain")}


def test_jsonl_sink_keeps_order_and_sorted_fields(spark, tmp_path):
    df = spark.range(500).repartition(9).select(F.col("id").alias("b"), (-F.col("id")).alias("a"))
    json_files.write_jsonl(df, str(tmp_path / "o"), ["b"])
    lines = [json.loads(x) for f in sorted((tmp_path / "o").glob("part-*.gz"))
             for x in gzip.open(f, "rt").read().splitlines()]
    assert [x["b"] for x in lines] == list(range(500)) and list(lines[0]) == ["a", "b"]


def test_outcome_scan(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"metrics": {"accuracy": 1.0}, "details": [{"instance_id": "a", "correct": True}]}))
    assert json_files.read_outcomes(spark, str(p)).collect()[0].correct is True


# ------------------------------------------------------------------ whole packs and blank texts

def test_pack_keeps_every_turn_and_one_blank_rule(spark):
    rows = [(1, "passage", i, f"t{i}") for i in range(11)] + [(2, "passage", 0, "\n\u00a0"), (2, "passage", 1, "x")]
    smp = spark.createDataFrame(rows, "instance_id int, template string, sample_index int, text string")
    whole = {r.instance_id: (r.n, r.usable) for r in samples.prefix_pack(smp).collect()}
    assert whole == {1: (11, True), 2: (2, False)}
    assert {r.instance_id: r.usable for r in samples.prefix_pack(smp, 2).collect()} == {1: True, 2: False}
    grid = smp.select(F.concat_ws(":", "instance_id", "sample_index").alias("sample_key"), "template", "sample_index")
    stored = smp.select(F.concat_ws(":", "instance_id", "sample_index").alias("sample_key"), "text")
    assert samples.audit(grid, stored).agg(F.sum("empty")).first()[0] == 1
    assert [r.sample_key for r in samples.audit_errors(grid, stored).collect()] == ["2:0"]


def test_short_queries_are_contained_too(spark):
    from imagora.plans import text_setup

    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "twofold"), (3, None)], "doc_id int, text string")
    qs = spark.createDataFrame([(0, "two three four"), (1, "two"), (2, "o three four five six seven e"), (3, "two three four five six seven nine")],
                               "instance_id int, query string")
    got = sorted((r.instance_id, r.doc_id) for r in text_setup.containment(docs, qs).collect())
    assert got == [(0, 1), (1, 1), (1, 2), (2, 1)]


def test_package_reaches_workers_and_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from imagora import session

    session.ship_package(spark)
    names = spark.range(1).mapInPandas(lambda it: (p.assign(id=len(__import__("imagora").__file__)) for p in it), "id long")
    assert names.first()["id"] > 0
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://h:1"))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def test_large_groups_draw_without_a_row_per_draw(spark, monkeypatch):
    monkeypatch.setattr(resample.sizing, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(resample, "DRAW_CHUNK", 3, raising=False)
    monkeypatch.setattr(resample, "DRAW_SLOTS", 4, raising=False)
    groups = {"x": [0, 1, 1, -1, 0.5, 2, 7], "y": [2, 3]}
    means = resample.hashed_means(diffs(spark, groups), ["g"], "v", 1500, 9)
    got = {(r.g, r.replicate): r["mean"] for r in means.collect()}
    for g, vs in groups.items():
        assert [got[(g, b)] for b in range(1500)] == pytest.approx(brute_means(g, vs, 1500, 9))
    # only the ranks of rows are joined, never the draws
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
