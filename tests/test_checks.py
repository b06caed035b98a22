"""Validators on rows made to fail, and appends that are repeated."""

from pyspark.sql import functions as F

from imagora.operators import checks, file_checks, gating, metrics, samples
from imagora.sources import json_files, vector_store


def failed(rows):
    return {(r.k, r.rule) for r in rows}


def test_value_rules_on_odd_json(spark):
    df = spark.createDataFrame(
        [(1, '{"v": 7}'), (2, '{"v": null}'), (3, None), (4, ""), (5, '{"w": 1}'), (6, '{"v": {"v": 1}}'), (7, '{"v": 1e400}')],
        "k int, p string")
    bad = failed(checks.violations(df, ["k"], checks.value_rules("p", "$.v")).collect())
    assert {r for k, r in bad if k == 1} == {"boolean", "list", "string"}
    every = {"object", "present", "integer", "number", "finite", "boolean", "list", "string"}
    assert {r for k, r in bad if k == 3} == {r for k, r in bad if k == 4} == every
    assert {r for k, r in bad if k == 5} == every - {"object"}
    assert (2, "number") in bad and (2, "object") not in bad
    assert (6, "present") not in bad and (6, "integer") in bad
    assert (7, "finite") in bad


def test_coverage_counts_repeated_rows_once(spark):
    run = spark.createDataFrame([("d", "a"), ("d", "a"), ("e", "x")], "domain string, instance_id string")
    wanted = spark.createDataFrame([("d", "a"), ("d", "b"), ("f", "q")], "domain string, instance_id string")
    got = {r.domain: (r.wanted, r.covered, r.missing, r.first_missing)
           for r in metrics.coverage(run, wanted, ["domain"]).collect()}
    assert got == {"d": (2, 1, 1, "b"), "f": (1, 0, 1, "q")}


def test_query_differences_take_nulls_and_both_sides(spark):
    s = "instance_id int, query string"
    big = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], s)
    small = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (5, "e")], s)
    got = {(r.instance_id, r.problem) for r in samples.query_differences(big, small).collect()}
    assert got == {(3, "query"), (4, "absent"), (5, "extra")}
    assert samples.query_differences(big.limit(0), small.limit(0)).count() == 0


def test_signal_misses_add_up(spark):
    asked = spark.createDataFrame([("d", i) for i in range(5)], "domain string, instance_id int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "instance_id int")
    r = gating.signal_misses(asked, ids(0, 1, 2, 2), ids(2, 3)).first()
    assert (r.asked, r.no_hits, r.no_samples, r.scored) == (5, 2, 2, 1)


def test_gold_differences_name_the_side(spark):
    s = "instance_id int, doc_id int"
    told = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], s)
    want = spark.createDataFrame([(1, 10), (2, 21)], s)
    got = {(r.instance_id, r.doc_id, r.side) for r in checks.gold_differences(told, want).collect()}
    assert got == {(2, 20, "extra"), (2, 21, "missing")}


def test_blank_queries_are_reported(spark):
    rows = spark.createDataFrame([("1", "d", "  "), ("2", "d", "q"), ("3", "d", None)],
                                 "instance_id string, domain string, query string")
    got = {(r.instance_id, r.problem) for r in json_files.instance_problems(rows, "d").collect()}
    assert got == {("1", "empty"), ("3", "empty")}


def test_restamp_evidence_changes_only_migrated_files(spark):
    meta = spark.createDataFrame([("a", 1, "old"), ("a", 2, "old"), ("b", 1, "new"), ("c", 1, "odd")],
                                 "file string, id int, source_revision string")
    got = {r.file: (r.action, r.before_sha256 != r.after_sha256)
           for r in checks.restamp_evidence(meta, ["file"], ["id", "source_revision"], "old", "new").collect()}
    assert got == {"a": ("migrated", True), "b": ("already_current", False), "c": ("rejected", False)}


def test_repeated_append_stores_each_content_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    texts = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id int, text string")
    vector_store.add_vectors(texts, path, "hashed64")
    vector_store.add_vectors(texts, path, "hashed64")
    assert vector_store.stored(spark, path, "hashed64").count() == 2
    more = texts.unionByName(spark.createDataFrame([(4, "four")], texts.schema))
    vector_store.add_vectors(more, path, "hashed64")
    vector_store.add_vectors(texts, path, "other")
    assert vector_store.stored(spark, path, "hashed64").count() == 3
    assert vector_store.vectors_of(more, path, "hashed64").count() == 4
    assert vector_store.stored(spark, path, "other").select(F.count_distinct("content_digest")).first()[0] == 2


def test_settled_paths(spark):
    told = ["a/b", "a//./b", "a/../b", "../b", "a/../../b", "/b", "file:/b", "", ".", "a/b/..", "..a/b", None]
    want = [("a/b", False), ("a/b", False), ("b", False), ("b", True), ("b", True), ("b", True), ("file:/b", True),
            ("", False), ("", False), ("a", False), ("..a/b", False), ("", True)]
    rows = spark.createDataFrame(list(enumerate(told)), "i int, p string")
    got = rows.select("i", file_checks.settled_path(F.col("p")).alias("s")).orderBy("i").collect()
    assert [(r.s.path, r.s.outside) for r in got] == want


def test_files_against_their_manifest(spark, tmp_path):
    import hashlib

    content = {"a.txt": b"one", "sub dir/b.bin": bytes(range(256)), "sub dir/c": b"", "d": b"four"}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    digest = {n: hashlib.sha256(d).hexdigest() for n, d in content.items()}
    files = file_checks.file_digests(spark, str(tmp_path))
    held = {n: (len(d), digest[n]) for n, d in content.items() if d}  # the scan skips empty files
    assert {r.path: (r.bytes, r.sha256) for r in files.collect()} == held
    rows = [("a.txt", 3, digest["a.txt"]), ("./sub dir/b.bin", 255, digest["a.txt"]), ("d", 4, None), ("x/../d", 4, None),
            ("gone", 1, ""), ("sub dir/c", 0, digest["sub dir/c"]), ("../a.txt", 3, digest["a.txt"]), (None, None, None)]
    manifest = spark.createDataFrame(rows, "path string, bytes bigint, sha256 string")
    got = sorted(map(tuple, file_checks.file_problems(manifest, files).collect()), key=str)
    assert got == sorted([
        ("sub dir/b.bin", "bytes", "255", "256"), ("sub dir/b.bin", "sha256", digest["a.txt"], digest["sub dir/b.bin"]),
        ("d", "repeated", "2", None), ("d", "sha256", None, digest["d"]), ("gone", "missing", "1", None),
        ("sub dir/c", "missing", "0", None), ("../a.txt", "outside", "../a.txt", None), (None, "outside", None, None)], key=str)
    assert file_checks.file_problems(manifest.limit(0), files).count() == 3


def test_json_digest_is_canonical(spark):
    import hashlib
    import json

    rows = [(1, 'a"\\\n\té', None, {"z": 1, "b": 2}), (2, "", 0.5, None)]
    df = spark.createDataFrame(rows, "k int, t string, v double, m map<string,int>")
    got = {r.k: r.d for r in df.select("k", file_checks.json_digest(df, ["v", "t", "m", "k"]).alias("d")).collect()}
    for k, t, v, m in rows:
        line = json.dumps({"k": k, "t": t, "v": v, "m": m}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[k] == hashlib.sha256(line.encode()).hexdigest()
