import random
import re

import oracle
import pytest
from edge import documents, edge_docs, empty_docs

from imagora.llm import licenses, queries
from imagora.llm.licenserules import BASE, RULES, WINDOW, Rule


def by_hand(text, rules=RULES):
    """(words, base places, matches left) by trying every rule at every word."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base, found = [], []
    for i in range(len(words)):
        rest = " ".join(words[i:]) + " "
        base += [(i, label) for phrase, label in BASE if rest.startswith(phrase + " ")]
        for r in rules:
            m = re.match(f"(?:{r.pattern}) ", rest)
            if m:
                found.append((i, i + m.group().count(" "), r))
    left = [a for a in found if not any(
        b[0] <= a[0] and b[1] >= a[1] and (b[2].priority, b[1] - b[0], -b[2].number) > (a[2].priority, a[1] - a[0], -a[2].number)
        for b in found)]
    return words, base, [(i, j, r.label, r.number) for i, j, r in left]


def test_rules_are_bounded_and_gated():
    assert len(RULES) >= 250
    for r in RULES:
        assert re.fullmatch("[0-9a-z]+", r.keyword) and re.match(rf"{r.keyword}(?![0-9a-z])", r.pattern)
        assert not re.search(r"[*+]", r.pattern.replace(r"\S+", "x"))
        assert r.pattern.count(" ") + 1 + sum(int(n) - 1 for n in re.findall(r",(\d+)\}", r.pattern)) <= WINDOW


def test_against_every_rule_at_every_word(spark):
    rng = random.Random(3)
    parts = [re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", r.pattern).replace("[sc]", "s").replace("?", "") for r in RULES]
    fill = "of the gnu license Lizenz, v2 - 2.0 CC by é apache MIT general public terms under licensed".split(" ")
    rows = []
    for i in range(120):
        words = [rng.choice(parts if rng.random() < 0.4 else fill) for _ in range(rng.randrange(1, 25))]
        rows.append((i, rng.choice([" ", "\n", "-", " / "]).join(w.upper() if rng.random() < 0.2 else w for w in words), "en", "a"))
    got = {r.doc: r for r in licenses.scan(documents(spark, rows)).collect()}
    seen = 0
    for i, text, *_ in rows:
        words, base, left = by_hand(text)
        assert got[i].n_words == len(words)
        assert [(b.start, b.label) for b in got[i].base] == base
        assert sorted((d.start, d.end, d.label, d.rule) for d in got[i].detections) == sorted(left)
        seen += len(left)
    assert seen > 500


def test_suppression_by_priority_and_containment(spark):
    rules = [Rule(0, "a", "a b c", "long", 1, 0.5), Rule(1, "b", "b", "strong", 2, 0.9), Rule(2, "b", "b c", "weak", 1, 0.5),
             Rule(3, "c", "c d", "over", 0, 0.1), Rule(4, "a", "a b c", "twin", 1, 0.4)]
    row = licenses.scan(documents(spark, [(1, "a b c d", "en", "s")]), rules=rules).first()
    # the shorter of equal priority goes, the stronger one inside stays, an overlap is no containment
    assert [(d.start, d.end, d.label) for d in row.detections] == [(0, 3, "long"), (1, 2, "strong"), (2, 4, "over")]


def test_labels_and_base(spark):
    docs = documents(spark, [
        (1, "Licensed under the Apache License, Version 2.0. MIT license; mit_license", "en", "a"),
        (2, "GNU lesser general public license version 2.1", "en", "a"), (3, "CC BY-NC 4.0 and ccby, ccé by", "en", "a"),
        (4, "gnu general public\x00license gnu general public license", None, None), (5, "nothing here", "en", "a")])
    got = {r.doc: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
           for r in licenses.label_documents(docs).collect()}
    assert got[1] == (3, 3, 10, "apache,mit", "apache,apache-2.0,mit", 0.9)
    assert got[2][:4] == (0, None, None, "") and "lgpl-2.1" in got[2][4].split(",")
    assert got[3] == (1, 0, 0, "cc-by", "cc-by,cc-by-nc", 0.9)
    assert got[4] == (2, 0, 4, "gpl", "gpl", 0.6)
    assert got[5] == (0, None, None, "", "", 0.0)


def test_edges(spark):
    rows = licenses.label_documents(edge_docs(spark)).collect()
    assert len(rows) == 13 and {r.score for r in rows} == {0.0}
    assert {r.n_words for r in rows if r.doc in (3, 4, 5)} == {0}
    long = documents(spark, [(1, "mit license " * 20000, "en", "a")])
    row = licenses.scan(long).first()
    assert row.n_words == 40000 and len(row.base) == 20000 and len(row.detections) == 20000
    assert licenses.label_documents(empty_docs(spark)).collect() == []


def test_no_python_and_no_shuffle(spark):
    plan = licenses.label_documents(documents(spark, [(1, "x", "en", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op13_license_rules"])
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    r = oracle.compare(spark, oracle.duck(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name])
    assert r["ok"] and r["rows"] > 0 and not r.get("types"), r
