import os
import random
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge import TEXTS, documents, edge_docs, empty_docs

from imagora.llm import linededup

SPACE = " \t\n\x0b\f\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda line: line.strip(SPACE).translate(ASCII)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3
                or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted(map(tuple, linededup.dedup_lines(docs, **kw).collect()), key=str)


def test_brute_force(spark):
    rng = random.Random(5)
    pool = [f"Line number {i} of the shared pool" for i in range(12)] + ["short", "", "  Line number 3 of the SHARED pool\t",
                                                                          "zwanzig zeichen äöü!"]
    rows = [(i % 50, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 150)))) for i in range(60)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows]).repartition(4)
    assert run(docs) == brute(rows)
    assert run(docs, batches=7, fanout=2) == brute(rows)


def test_runs_are_levelled_and_tell_new_lines(spark):
    runs = linededup.LineRuns(fanout=2)
    rows = documents(spark, [(i, f"a line that is only in {i}", None, None) for i in range(5)])
    lines = linededup.long_lines(rows, "doc_id", "text", 5).drop("batch")
    for i in range(5):
        assert runs.unseen(lines.filter(f"doc = {i}")).count() == 1
        runs.add(lines.filter(f"doc = {i}"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.unseen(lines).count() == 0 and runs.repeated(1).count() == 5


def test_edges(spark):
    assert run(edge_docs(spark)) == brute([(i, t) for i, t, *_ in TEXTS])
    assert linededup.dedup_lines(empty_docs(spark)).count() == 0
