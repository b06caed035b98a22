import os
import random
import re
import sys

import numpy as np
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge import TEXTS, documents, edge_docs, empty_docs

from imagora.llm import components, simhash


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, links):
    top = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if (top[a], top[b]) != (low, low):
                top[a] = top[b] = low
                changed = True
    return top


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    n = len(rows)
    top = closure(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    first = {}
    for (i, _), c in zip(rows, top):
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", first[c]) for (i, _), f, c in zip(rows, fps, top)), key=str)


def test_groups_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(200)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(200)] = word().upper()
            rows.append((len(rows), "  ".join(copy)))
    got = simhash.fingerprint_groups(documents(spark, [(i, t, None, None) for i, t in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert 12 <= len({c for *_, c in brute(rows)}) < 96


def test_light_and_heavy_buckets_link_the_same(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, 3)
    fps = {int(b) ^ (simhash.signed(1 << int(i)) if i < 64 else 0) ^ (simhash.signed(1 << int(j)) if j < 64 else 0)
           for b in base for i, j in rng.integers(0, 70, (80, 2))}
    fps = sorted(simhash.signed(f % (1 << 64)) for f in fps)
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = closure(len(fps), [(a, b) for a in range(len(fps)) for b in range(a)
                              if ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 2])
    for light in (1, 5, 1000):
        links = [(fps.index(r.a), fps.index(r.b)) for r in simhash.link(table, light).collect()]
        assert all(((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 2 for a, b in links)
        assert closure(len(fps), links) == want


def test_pivot_gap_never_exceeds_the_distance(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(a) ^ (1 << int(i)) ^ (1 << int(j))) for a, i, j in
            zip(rng.integers(-2 ** 62, 2 ** 62, 50), rng.integers(0, 60, 50), rng.integers(0, 60, 50))]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    gap = simhash.pivot_gap(simhash.pivot_table(df.a), simhash.pivot_table(df.b))
    assert all(r[0] <= r[1] for r in df.select(gap, simhash.hamming(df.a, df.b)).collect())


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(1)
    chain = rng.sample(range(1000), 300)
    edges = list(zip(chain, chain[1:])) + [(2000, 2000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[x] for x in chain} == {min(chain)} and {got[2000 + i] for i in range(200)} == {2000}
    assert len(got) == 500
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, group = [], []
    for g in range(30):
        base = [word() for _ in range(rng.choice([120, 300]))]
        for v in range(rng.randint(1, 4)):
            copy = list(base)
            if v:
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), None, None))
            group.append(g)
        half = base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]  # far from 0.8
        rows.append((len(rows), " ".join(half), None, None))
        group.append(100 + g)
    kept = {r.doc_id for r in simhash.near_copies(documents(spark, rows)).collect()}
    # copies are at 0.9 or more, the halves below 0.4
    assert kept == {group.index(g) for g in group}


def brute_kept(texts, k=5, least=0.8):
    """Ids that stay and the similarities of all pairs."""
    sets = [{tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    return {i for i, c in enumerate(closure(len(texts), [p for p, s in sims.items() if s >= least])) if i == c}, sims


def test_common_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(9)]
    got = simhash.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def test_copies_inside_a_boilerplate_family(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    licence = [word() for _ in range(165)]
    texts = []
    for _ in range(60):  # pairs of copies; different pairs share the licence
        own = [word() for _ in range(35)]
        for _ in range(2):
            copy = licence + own
            if rng.random() < 0.8:
                for _ in range(rng.choice([1, 2])):
                    copy[rng.randrange(165, 200)] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    want, sims = brute_kept(texts)
    assert sum(0.65 < s < 0.75 for s in sims.values()) > 0.9 * len(sims) and len(want) == 60
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    monkeypatch.setattr(simhash, "CELL", 16)
    for light in (simhash.LIGHT, 2, 1000):
        assert {r.doc_id for r in simhash.near_copies(docs, light=light).collect()} == want


def test_bound_is_exact(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for g in range(150):  # an edit in the middle of n words costs five shingles
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        copy = list(base)
        for _ in range(round(len(base) / 5 * rng.uniform(0.08, 0.16))):
            copy[rng.randrange(len(copy))] = word()
        texts += [" ".join(base), " ".join(copy)]
    want, sims = brute_kept(texts)
    near = [s for s in sims.values() if s > 0]
    assert sum(0.73 < s < 0.8 for s in near) > 20 and sum(0.8 <= s < 0.87 for s in near) > 20
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    assert {r.doc_id for r in simhash.near_copies(docs).collect()} == want


def test_edges(spark):
    got = sorted(map(tuple, simhash.fingerprint_groups(edge_docs(spark)).collect()), key=str)
    assert got == brute([(i, t) for i, t, *_ in TEXTS])
    assert simhash.fingerprint_groups(empty_docs(spark)).count() == 0
    kept = [r.doc_id for r in simhash.near_copies(edge_docs(spark)).collect()]
    assert 1 in kept and 2 not in kept and kept.count(1) == 1
    assert simhash.near_copies(empty_docs(spark)).count() == 0
