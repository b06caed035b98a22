"""Rows that every operator on documents must take."""

LONG = "wort " * 30000 + "\n" + "zeile von genug zeichen hier\n" * 3000

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size string, fp string, "
          "label string, h string, drop string, copies string, pattern string, key string, hits string, score string")
EXTRA = ("x",) * 11

TEXTS = [
    (1, "The first text of this table, with a few words in it.", "en", "b"),
    (1, "The first text of this table, with a few words in it.", "en", "b"),
    (2, "The first text of this table, with a few words in it.", "en", None),
    (3, None, None, "a"), (4, "", "en", "a"), (5, " \t\n ", "de", "a"), (6, "Wort", "de", ""),
    (7, "!!! 123 ###", None, "a"), (8, LONG, "de", "a"), (None, "A text without id.", "en", "c"),
    (None, None, None, None), (9, "Zwei Wörter", "de", "c"), (10, "\x00 odd   é\U0001F600", "fr", "c")]


def edge_docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as a table."""
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
