import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge import documents, edge_docs, empty_docs

from imagora.llm import decontam

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 90))
        assert decontam.common_subsequence(a.astype(np.uint64), b.astype(np.uint64)) == lcs(a.tolist(), b.tolist())


def test_word_hashes():
    texts = ["Ab cd-EF, 12", None, "", "é1é éé", "ab", "a" * 40 + " " + "a" * 39 + "b", "cd"]
    t = decontam.tokens(pa.array(texts))
    words = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower()) for x in texts]
    flat = [w for ws in words for w in ws]
    assert [len(w) for w in words] == np.diff(t.first).tolist()
    assert len(set(zip(flat, t.hashes.tolist()))) == len(set(flat)) == len(set(t.hashes.tolist()))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_copies_and_paraphrases_are_found(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [(i, words(rng.randint(15, 70))) for i in range(25)]
    rows, want = [], set()
    for i in range(300):
        text = words(rng.randint(20, 600))
        if i % 6 == 0:
            item, passage = bench[i // 6 % 25]
            copy = list(passage)
            if i % 12 == 0:  # one word in twelve replaced, none of the last four
                for at in range(0, len(copy) - 4, 12):
                    copy[at] = rng.choice(vocab)
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in copy]
            want.add((i, item))
        rows.append((i, "\n".join([" ".join(text[:50]), " ".join(text[50:])]), None, None))
    found = decontam.contaminated(documents(spark, rows).repartition(4), items(spark, [(i, " ".join(w)) for i, w in bench]))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == want
    assert all(r.share == 1 for (i, _), r in got.items() if i % 12)


def brute_leaks(texts, bench):
    """All (text, item) of which some window passes the checks."""
    out = set()
    for d, text in enumerate(texts):
        for i, (item, answer) in enumerate(bench):
            width = -(-(len(item) + decontam.STEP - 1) // decontam.STEP) * decontam.STEP
            for at in range(0, len(text), decontam.STEP):
                window = text[at:at + width]
                if len(set(item) & set(window)) > 2:
                    share = lcs(item, window) / len(item)
                    answered = len(answer) > 0 and lcs(answer, window) == len(answer)
                    if share >= 0.8 or (answered and share >= 0.6):
                        out.add((d, i))
    return out


def test_loose_paraphrases_and_short_items_are_found(spark):
    rng = random.Random(18)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8))) for _ in range(1500)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = []
    for i in range(40):
        item = words(rng.choice([5, 6, 8, 10, 12, 15, 16, 39]))
        bench.append((item, item[-2:]))
    texts, planted = [], 0
    for i in range(200):
        item, answer = bench[i % 40]
        copy, share = list(item), rng.choice([0.6, 0.7, 0.8, 1.0])
        for at in rng.sample(range(len(item) - 2), int((1 - share) * len(item) + 1e-9)):
            copy[at] = rng.choice(vocab)
        if i % 3 == 0:
            copy.insert(rng.randrange(len(copy)), rng.choice(vocab))
        text = words(rng.randint(40, 200))
        at = rng.randrange(len(text))
        texts.append(text[:at] + copy + text[at:])
        planted += share < 0.8
    want = brute_leaks(texts, bench)
    assert len(want) >= 200 and planted > 60
    rows = [(i, f"{' '.join(item[:-2])}. {' '.join(answer)}") for i, (item, answer) in enumerate(bench)]
    found = decontam.contaminated(documents(spark, [(i, " ".join(t), None, None) for i, t in enumerate(texts)]),
                                  items(spark, rows))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_the_cosine_tells_reordered_items_from_common_words(spark):
    rng = random.Random(28)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    common = ["".join(rng.choice("klmnop") for _ in range(3)) for _ in range(12)]
    words = lambda n: [rng.choice(rare if i % 2 else common) for i in range(n)]
    bench = [words(32) for _ in range(8)]
    rows = []
    for i in range(160):
        text = words(120)
        if i < 8:  # the second half of the item before the first, where a window begins
            text[40:72] = bench[i][16:] + bench[i][:16]
        rows.append((i, " ".join(text), None, None))
    found = decontam.contaminated(documents(spark, rows), items(spark, [(i, " ".join(w)) for i, w in enumerate(bench)]))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == {(i, i) for i in range(8)}
    assert all(r.share < decontam.MIN_COMMON and r.cosine >= decontam.MIN_COSINE - 1e-6 for r in got.values())
    item, window = np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64)[::-1]
    assert decontam.is_reordered(item, window, 0.95) and not decontam.is_reordered(item, window, 0.5)
    assert not decontam.is_reordered(np.repeat(item[:2], 5), window, 0.95)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_planted_passages(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want


def test_edges(spark):
    bench = items(spark, [(1, "Zwei Wörter"), (2, None), (None, "text"), (3, "..."), (4, "zeile von genug zeichen hier"), (1, "Zwei Wörter")])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(edge_docs(spark), bench).collect()}
    assert (8, 4) in got and {d for d, _ in got} <= {8, 9}
    assert decontam.contaminated(empty_docs(spark), bench).count() == 0
    assert decontam.contaminated(edge_docs(spark), items(spark, [])).count() == 0
