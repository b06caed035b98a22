import random
import re
import zlib

import oracle
import pytest
from edge import documents, edge_docs, empty_docs

from imagora.llm import queries, spelling


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def by_hand(counts):
    got = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        top = min(near, key=lambda x: (-counts[x], x), default=None)
        form = top if top is not None and counts[top] >= 5 * n else None
        got[w] = [n, len(near), form, counts[form] if form else None]
    for w in got:
        root = w
        while got[root][2]:
            root = got[root][2]
        got[w].append(root)
    return {w: tuple(v) for w, v in got.items()}


def rows_of(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def vocabulary(rng, n, letters="abé", low=2, high=9):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)}
    return {w: rng.choice([5, 6, 30, 31, 200, 1200, 7000]) for w in words}


@pytest.mark.parametrize("split,chars", [(2048, 1 << 22), (8, 1 << 22), (1, 1 << 22), (2048, 40)])
def test_pairs_against_brute_force(spark, split, chars):
    counts = vocabulary(random.Random(split + chars), 350)
    counts.update({"x" * 400: 5, "x" * 401: 5, "x" * 399 + "y": 30, "q": 5, "a": 9})
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(df, split=split, split_chars=chars)) == by_hand(counts)


def test_blocks_and_batches(spark):
    # one group of more rows than a block, over several Arrow batches
    rng = random.Random(9)
    counts = {"anfang" + "".join(rng.choice("abcd") for _ in range(6)): rng.randrange(5, 5000) for _ in range(900)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
        assert rows_of(spelling.variants(df)) == by_hand(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chain_of_forms(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {r.root for r in spelling.variants(df).collect()} == {"abbbbb"}


def test_words_with_dropped_letters(spark):
    rng = random.Random(4)
    stems = ["Wörter", "KLEINE", "Über", "straße", "×mal÷", "naïveté", "sechse", "siebenen"]
    texts = [(i if i % 7 else None, " ".join(rng.choice(stems) for _ in range(60)) + "-x1y2straße", "de", "a") for i in range(300)]
    counts = {}
    for i, text, *_ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in spelling.words(documents(spark, texts)).collect()} == want
    assert any(w not in {s.lower() for s in stems} for w in want)


def test_edges(spark):
    assert spelling.group_spellings(empty_docs(spark)).collect() == []
    got = rows_of(spelling.group_spellings(edge_docs(spark)))
    assert got["zeichen"] == (3000, 0, None, None, "zeichen") and got["genug" + ""] if "genug" in got else True
    same = documents(spark, [(1, "gleich anders", "de", "a")] * 5 + [(2, "gleicht " * 5, "de", "a"), (3, None, None, None)])
    assert rows_of(spelling.group_spellings(same)) == {
        "gleich": (5, 1, None, None, "gleich"), "gleicht": (5, 1, None, None, "gleicht"), "anders": (5, 0, None, None, "anders")}


def test_query_matches_sql(spark):
    sf, name = "/root/testdata/sf0.01", "op11_spelling_variants"
    r = oracle.compare(spark, oracle.duck(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name])
    assert r["ok"] and r["rows"] > 0 and not r.get("types"), r
