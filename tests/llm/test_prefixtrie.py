import hashlib
import random
import zlib

import oracle
import pytest

from imagora.llm import prefixtrie, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n string, low string, depth string"


def table(spark, turns):
    return spark.createDataFrame([(*t, "x", "y", "z") for t in turns], SCHEMA).repartition(3)


def rebuilt_by_hand(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            digest = hashlib.md5((text or "").encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", digest, text or ""))
    own = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(int(c / 100) * 100, [])
        out[c] = base[:h] + own[c][h:]
    return out


def nodes_by_hand(convs):
    members = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    rows = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = lambda x: sum(1 for y in members if len(y) == len(x) + 1 and y[:len(x)] == x)
        ends = sorted(c for c in m if len(convs[c]) == len(node))
        rows.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids(node),
                     sum(1 for x in below if kids(x) == 0),
                     sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_turns(seed, convs, ids=300):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(-100, ids), convs):
        for turn in range(rng.choice([0, 1, 2, 3, 6, 7, 9, 14])):
            turns.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]),
                          rng.choice(["a", "bb", "", None, "é\U0001F600"])))
    return turns


@pytest.mark.parametrize("seed,convs", [(1, 40), (2, 90)])
def test_against_brute_force(spark, seed, convs):
    turns = random_turns(seed, convs)
    assert got(prefixtrie.conversation_trie(table(spark, turns))) == nodes_by_hand(rebuilt_by_hand(turns))


@pytest.mark.parametrize("ends", [(16,), (2, 5, 16)])
def test_batches_give_the_same_trie(spark, ends):
    rng = random.Random(7)
    # deep chains with branches at every depth, and paths that end inside other paths
    convs = {}
    for c in range(80):
        path = [("u", f"{rng.random() < 0.1}") for _ in range(rng.choice([0, 1, 5, 17, 33]))]
        convs[c] = path
    turns = [(c, i, r, t) for c, p in convs.items() for i, (r, t) in enumerate(p)] + []
    df = prefixtrie.trie_nodes(prefixtrie.paths(prefixtrie.turn_arrays(table(spark, turns))), ends)
    assert got(df) == nodes_by_hand({c: p for c, p in convs.items() if p})


def test_search_exits_like_a_scan(spark):
    rng = random.Random(5)
    path = lambda: [("u", rng.choice("ab")) for _ in range(rng.randrange(1, 12))]
    known, asked = {c: path() for c in range(30)}, {c: path() for c in range(40)}
    as_paths = lambda convs: prefixtrie.paths(prefixtrie.turn_arrays(table(
        spark, [(c, i, r, t) for c, p in convs.items() for i, (r, t) in enumerate(p)])))
    trie = prefixtrie.ZFastTrie(spark)
    first = as_paths(known).dropDuplicates(["u0", "u1"])
    trie.insert(first.drop("conv_id"), 12)
    depth = {r.conv_id: r.s for r in trie.locate(as_paths(asked), 12).collect()}
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert depth == {c: max(share(p, q) for q in known.values()) for c, p in asked.items()}


def test_two_fattest(spark):
    rows = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", prefixtrie.two_fattest(F.col("a"), F.col("b")).alias("f"))
    zeros = lambda n: n & -n
    assert all(zeros(r.f) == max(zeros(n) for n in range(r.a + 1, r.b + 1)) and r.a < r.f <= r.b for r in df.collect())


def test_edges(spark):
    assert got(prefixtrie.conversation_trie(table(spark, []))) == []
    assert got(prefixtrie.conversation_trie(table(spark, [(None, 1, "user", "x")]))) == []
    # one turn each and a base that is absent: most are turnless
    turns = [(c, 0, "user", "x") for c in range(101, 130)]
    assert got(prefixtrie.conversation_trie(table(spark, turns))) == nodes_by_hand(rebuilt_by_hand(turns))
    # repeated rows are turns of their own; a hot conversation in many copies; a long text
    turns = [(c, i, "user", "hi") for c in range(200, 400) for i in (0, 0, 1)] + [(500, i, "u", "wort " * 40000) for i in range(400)]
    want = rebuilt_by_hand(turns)
    rows = got(prefixtrie.conversation_trie(table(spark, turns)))
    assert len(rows) == len({tuple(p[:d]) for p in want.values() for d in range(len(p) + 1)})
    root = next(r for r in rows if r[1] == 0)
    assert root[3] == 201 and max(r[1] for r in rows) == len(want[500])


def test_digest_of_many_pieces(spark):
    ids = random.Random(2).sample(range(-50000, 50000), 3000)
    df = spark.createDataFrame([(c, 1, 2) for c in ids], "conv_id bigint, u0 bigint, u1 bigint").repartition(4)
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert [r.sha for r in prefixtrie.member_digests(df).collect()] == [want]


def test_query_matches_sql(spark):
    sf, name = "/root/testdata/sf0.01", "op12_conversation_trie"
    r = oracle.compare(spark, oracle.duck(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name])
    assert r["ok"] and r["rows"] > 0 and not r.get("types"), r
