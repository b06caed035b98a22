import numpy as np
import pytest
from pyspark.sql import functions as F

from imagora.functions import prompts
from imagora.functions import text as tx

DOC = "Intro line\n\n```sql\nSELECT 1\n```\nbetween\n```\nraw\n```\nend"


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


def test_fields_split_code_from_body(spark):
    f = one(spark, tx.fields(F.col("n"), F.col("d"), F.col("c")), n="q7", d="Two fences", c=DOC)
    assert f.meta == "q7. Two fences"
    assert f.code.split() == ["SELECT", "1", "raw"]
    assert "SELECT" not in f.body and f.body.startswith("Intro line") and f.body.split()[-2:] == ["between", "end"]


@pytest.mark.parametrize("name,desc,want", [
    ("a..", "b", "a. b"), ("a", " ", "a"), ("", "b", "b"), (None, None, ""), (" a ", " b. ", "a. b.")])
def test_meta(spark, name, desc, want):
    assert one(spark, tx.meta(F.col("n"), F.col("d")), n=name, d=desc) == want


def gen(spark, md):
    return one(spark, tx.generated_fields(F.col("md")), md=md)


def test_generated_with_header(spark):
    f = gen(spark, "---\nowner: me\ndescription: a: b: c\nname:   spaced  \n---\n\n\n> quote\n")
    assert (f.meta, f.body, f.code) == ("spaced. a: b: c", "> quote", "")


def test_generated_last_key_wins_and_case_is_ignored(spark):
    f = gen(spark, "---\nname: a\nNAME: b\nnote\n---\nrest")
    assert (f.meta, f.body) == ("b", "rest")


def test_generated_without_header(spark):
    f = gen(spark, "# A passage.\n\nSecond line.\n```\nz\n```")
    assert (f.meta, f.body, f.code) == ("A passage.", "Second line.", "z")


def test_generated_outer_fence(spark):
    f = gen(spark, "```\nTitle of it\n\ntext one\n```js\nlet a\n```\ntext two\n```\n")
    assert f.meta == "Title of it" and "text one" in f.body and "text two" in f.body and f.code == "let a"


@pytest.mark.parametrize("md", ["", "   ", None])
def test_generated_empty(spark, md):
    assert tuple(gen(spark, md)) == ("", "", "")


def test_sentences_keep_long_parts(spark):
    s = one(spark, tx.sentences(F.col("t")),
            t="Short. This one is long enough to stay.\nAnother line of enough length;no")
    assert s == ["This one is long enough to stay", "Another line of enough length"]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="\u00a0Ein\u2003ZWEI\n\x1cdrei\t") == ["ein", "zwei", "drei"]
    assert one(spark, tx.tokens(F.col("t")), t=" ") == []


@pytest.mark.parametrize("raw,want", [
    ("['a', 'b']", ["a", "b"]), ("[]", []), ("('x',)", ["x"]), ('["it\'s"]', ["it's"]), ("plain", ["plain"]),
    ("", []), (None, []), ("['broken", ["['broken"]), ("'quoted'", ["quoted"]), ("[1, 2]", ["1", "2"]),
    ("['a, b', 'c']", ["a, b", "c"])])
def test_decode_list(spark, raw, want):
    assert one(spark, tx.decode_list(F.col("v")), v=raw) == want


def test_render(spark):
    p = one(spark, prompts.render(F.lit(prompts.TEMPLATES["passage"]), F.col("q")), q="add {q} up")
    assert p.endswith("Task: add {q} up") and p.count("{q}") == 1


def test_stand_in_keeps_first_characters(spark):
    md = one(spark, tx.stand_in_document(F.col("q")), q="y" * 200)
    assert "description: " + "y" * 120 + "\n---" in md and tx.STAND_IN_CODE in md


def test_encoder_sees_a_bounded_number_of_tokens(spark, monkeypatch):
    from pyspark.sql import functions as F

    from imagora.operators import encode

    monkeypatch.setattr(encode, "TOKENS_AT_ONCE", 40, raising=False)
    encoder = encode.HashedEncoder(8)

    def bounded(lists, most=40):
        assert len(lists) == 1 or sum(len(t) for t in lists) <= most
        return encoder(lists)

    words = [["a", "b"] * (i % 7) + (["long"] * 90 if i == 5 else []) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id int, words array<string>").coalesce(1)
    got = {r.doc_id: r.vec for r in rows.select("doc_id", encode.encode_tokens(F.col("words"), bounded).alias("vec")).collect()}
    want = encode._unit_rows(encoder(words))
    assert all(got[i] == pytest.approx(want[i].tolist()) for i in range(60))


def test_tokens_break_at_white_space_alone(spark):
    kept = ["a", "!", "~", "\x7f", "\x00", "​", "é", "漢", "\U0001f600"]
    text = "".join(f"{w}{c}" for c in tx.WHITESPACE for w in kept) + "B"
    got = one(spark, tx.tokens(F.col("q")), q=text)
    for i in range(len(tx.WHITESPACE)):
        assert got[i * len(kept):(i + 1) * len(kept)] == kept
    assert got[-1] == "b" and len(got) == len(kept) * len(tx.WHITESPACE) + 1
    assert one(spark, tx.tokens(F.col("q")), q=" " + tx.WHITESPACE) == []


def test_encoder_makes_strings_of_distinct_tokens_alone():
    import pyarrow as pa

    from imagora.operators import encode

    lists = [["a", "b", "a"], None, [], ["é", "b"] * 5, ["a"]]
    encoder = encode.HashedEncoder(8)
    whole = pa.array(lists, pa.list_(pa.string()))
    want = encoder([t or [] for t in lists])
    assert (encoder.of_lists(whole) == want).all()
    parts = list(encode._slices(whole, 4))
    assert [len(p) for p in parts] == [3, 1, 1]
    assert (np.concatenate([encoder.of_lists(p) for p in parts]) == want).all()
