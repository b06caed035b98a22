import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge import TEXTS, documents, edge_docs, empty_docs

from imagora.llm import separators


def spans(tokens, end):
    out, start = [], 0
    for p in np.flatnonzero(tokens == end).tolist():
        out.append((start, p - start, True))
        start = p + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


def test_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(separators, "GROUP", 4)
    rng = np.random.default_rng(6)
    files = {f: rng.integers(0, hi, n).astype("<u2") for f, hi, n in ((0, 3, 500), (1, 90, 700), (2, 2000, 300), (3, 1, 20))}
    files[4] = np.full(64, 9, "<u2")
    rows = [(f, b, t[b * 16:(b + 1) * 16].tobytes()) for f, t in files.items() for b in range(-(-len(t) // 16))]
    blocks = spark.createDataFrame(rows, "file int, block bigint, tokens binary").repartition(5)
    got = separators.document_spans(blocks, end=0, width=2).collect()
    for f, t in files.items():
        mine = sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in got if r.file == f)
        assert mine == [(i, *s) for i, s in enumerate(spans(t, 0))]


def test_raw_files(spark, tmp_path):
    t = np.array([5, 6, 0, 7, 0, 0, 8, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(t.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = separators.read_flat(spark, str(tmp_path), 2, block_tokens=3)
    got = separators.document_spans(blocks, end=0, width=2).collect()
    assert sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in got) == [(i, *s) for i, s in enumerate(spans(t, 0))]


def test_documents_round_trip(spark):
    rows = [(i, "é" * (i * 37 % 101), None, None) for i in range(200)]
    got = separators.token_counts(documents(spark, rows).repartition(3), block_tokens=64).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, 2 * (i * 37 % 101)) for i in range(200)]


def test_edges(spark):
    got = separators.token_counts(edge_docs(spark)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").encode())) for i, t, *_ in TEXTS)
    assert separators.token_counts(empty_docs(spark)).count() == 0
