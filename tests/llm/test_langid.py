import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from edge import TEXTS, documents, edge_docs, empty_docs

from imagora.llm import langid

SF = "/root/testdata/sf0.01"


def test_table_lookup_equals_convolution():
    rng = np.random.default_rng(0)
    model = langid.train([bytes(rng.integers(97, 123, 80, dtype=np.uint8)) for _ in range(20)], ["a", "b"] * 10, epochs=1)
    windows = rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    for w in langid.WIDTHS:
        assert np.allclose(model.fast_max(windows, w), model.responses(windows, w).max(axis=1), atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = langid.train([bytes(rng.integers(97, 123, 80, dtype=np.uint8)) for _ in range(20)], ["a", "b"] * 10, epochs=1)
    model.tables = {w: t.astype(np.float64) for w, t in model.tables.items()}
    model.out = model.out.astype(np.float64)
    x, y = rng.integers(97, 123, (6, langid.WINDOW), dtype=np.uint8), np.array([0, 1, 1, 0, 1, 0])

    def loss():
        hidden = np.concatenate([model.responses(x, w).max(axis=1) for w in langid.WIDTHS], axis=1) + model.bias
        p = langid.softmax(np.maximum(hidden, 0) @ model.out + model.out_bias)
        return -np.log(p[np.arange(6), y]).mean()

    grads = langid.gradients(model, x, y)
    for params, grad in ((model.tables[3], grads[1]), (model.out, grads[-2])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        base = loss()
        params[at] += 1e-5
        assert (loss() - base) / 1e-5 == pytest.approx(grad[at], rel=0.02, abs=1e-6)
        params[at] -= 1e-5


def test_whole_texts_count():
    rng = np.random.default_rng(2)
    de = ["das ist ein text der lang ist und weiter geht " * 4] * 30
    en = ["this is the text that goes on and on with the words " * 4] * 30
    model = langid.train([t.encode()[int(rng.integers(50)):] for t in de + en], ["de"] * 30 + ["en"] * 30)
    probs = langid.text_probabilities(model, pa.array([de[0] + en[0] * 9, de[0] * 9 + en[0], "", None]))
    assert probs.argmax(axis=1)[:2].tolist() == [1, 0]
    assert np.allclose(probs.sum(axis=1), 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = langid.identify(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1
    assert langid.identify(empty_docs(spark)).count() == 0
    unlabelled = documents(spark, [(1, "words", None, None)])
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"
