import hashlib
import math
import os
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge import TEXTS, edge_docs, empty_docs

from imagora.llm import sharding


def owner(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / weights[s], s

    return min(map(score, range(len(weights))))[1]


def test_brute_force(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_documents(docs, 5).collect()
    for r in rows:
        text = f"é{r.doc_id}".encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert (r.shard, r.grown_shard) == (owner(r.doc_id, [1] * 5), owner(r.doc_id, [1] * 6))
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_growth_only_feeds_the_new_shard_and_weights_count(spark):
    rows = sharding.assign(spark.range(3000), F.col("id"), [1, 3], 4.0).collect()
    assert all(r.grown_shard in (r.shard, 2) for r in rows)
    share = Counter(r.shard for r in rows)[1] / 3000
    moved = sum(r.grown_shard == 2 for r in rows) / 3000
    assert abs(share - 0.75) < 0.04 and abs(moved - 0.5) < 0.04
    with pytest.raises(ValueError):
        sharding.assign(spark.range(3), F.col("id"), [1, 0])


def test_edges(spark):
    rows = sharding.shard_documents(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {(8, 0)}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({r.slot for r in rows if r.doc_id == 1}) == 2
    assert sharding.shard_documents(empty_docs(spark)).count() == 0
