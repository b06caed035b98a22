"""License scan: ordered signature rules behind a keyword gate, inside the row.

A text becomes an array of words, and each is looked up in the set of keywords.
Only the place of a keyword opens a window of ``WINDOW`` words, and only the
rules of that keyword are tried at its start. A match is an interval of words. It is
suppressed if a match of higher priority, or a longer one of its own priority,
contains it. Everything is an expression over one row: no text is copied and
nothing is shuffled, so a source or text that fills a third of the table costs
what its words cost.

Defined results: a null text is an empty one (no words, no matches, score 0);
a null id and repeated rows are rows like any other; an empty table gives none;
a very long text is scanned whole, its words in one array. Columns other than
the two named are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import LOWER, UPPER
from imagora.llm.licenserules import BASE, BASE_WEIGHT, RULES, WINDOW, Rule

#: ASCII letters and digits, and everything beyond ASCII.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

_RULE = "struct<number:int,pattern:string,label:string,priority:int,weight:double>"


def _by_keyword(rules: list[Rule]) -> dict[str, list[Rule]]:
    found: dict[str, list[Rule]] = {}
    for rule in rules:
        found.setdefault(rule.keyword, []).append(rule)
    return found


def _rule_map(rules: list[Rule]) -> Column:
    """Rules by keyword, as a constant; a pattern holds at the start and ends with a word."""
    table = {keyword: [{"number": r.number, "pattern": f"^(?:{r.pattern}) ", "label": r.label, "priority": r.priority,
                        "weight": r.weight} for r in own] for keyword, own in _by_keyword(rules).items()}
    return F.from_json(F.lit(json.dumps(table)), f"map<string,array<{_RULE}>>")


def _found(hit: Column, rule: Column) -> Column:
    """The interval of words that a rule matches at a hit; empty where it does not."""
    match = F.call_function("regexp_extract", hit["window"], rule["pattern"], F.lit(0))
    words = F.char_length(match) - F.char_length(F.translate(match, " ", ""))
    return F.struct(hit["start"].alias("start"), (hit["start"] + words).alias("end"), rule["label"].alias("label"),
                    rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["number"].alias("rule"))


def _beats(other: Column, own: Column) -> Column:
    """Whether ``other`` contains ``own`` and ranks before it."""
    contains = (other["start"] <= own["start"]) & (other["end"] >= own["end"])
    longer = (other["start"] < own["start"]) | (other["end"] > own["end"])
    first = (other["priority"] > own["priority"]) | (
        (other["priority"] == own["priority"]) & (longer | (other["rule"] < own["rule"])))
    return contains & first


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(doc, n_words, base, detections): one row per document.

    ``base`` holds (start, label) of every place of a base phrase, ``detections``
    (start, end, label, priority, weight, rule) of the matches left, by start;
    words are counted from 0 and ``end`` is the word after the last.
    """
    rules = RULES if rules is None else rules
    own = _by_keyword(rules)
    phrases = {phrase.split(" ")[0]: phrase for phrase, _ in BASE}
    keywords = sorted({*own, *(phrase.split(" ")[0] for phrase, _ in BASE)})
    # matches that can contain another one start at most WINDOW words before it
    most = max((len(r) for r in own.values()), default=1)

    words = docs.select(F.col(f"`{id_col}`").alias("doc"), F.regexp_extract_all(
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(keywords), i)), lambda i: i.isNotNull())
    # word by word: slice would copy the whole array for each hit
    window = lambda p: F.concat(F.translate(F.array_join(F.transform(
        F.sequence(p, p + F.lit(WINDOW - 1)), lambda k: F.get("words", k)), " "), UPPER, LOWER), F.lit(" "))
    hits = words.select("doc", F.size("words").cast("bigint").alias("n_words"), F.transform(places, lambda p: F.struct(
        p.alias("start"), F.lower(F.get("words", p)).alias("keyword"), window(p).alias("window"))).alias("hits"))

    base = F.filter(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), F.coalesce(*[
        F.when(h["window"].startswith(phrase + " "), F.lit(label)) for phrase, label in BASE]).alias("label"))),
        lambda b: b["label"].isNotNull())
    tried = F.flatten(F.transform("hits", lambda h: F.transform(
        F.coalesce(F.element_at(_rule_map(rules), h["keyword"]), F.array().cast(f"array<{_RULE}>")),
        lambda r: _found(h, r))))
    matched = hits.select("doc", "n_words", base.alias("base"), F.filter(tried, lambda d: d["end"] > d["start"]).alias("all"))

    reach = WINDOW * most
    near = lambda i: F.transform(F.sequence(F.greatest(i - F.lit(reach), F.lit(0)), F.least(
        i + F.lit(most), F.size("all") - F.lit(1))), lambda k: F.get("all", k))
    left = F.filter("all", lambda d, i: ~F.exists(near(i), lambda e: _beats(e, d)))
    return matched.select("doc", "n_words", "base", left.alias("detections"))


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    rules: list[Rule] | None = None) -> DataFrame:
    """(doc, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Base labels stay whatever the rules find; ``score`` is the largest weight of
    a match left or of a base phrase, 0 without any.
    """
    base_labels = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["start"].cast("bigint"))
    weights = F.concat(F.transform("detections", lambda d: d["weight"]), F.transform("base", lambda b: F.lit(BASE_WEIGHT)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan(docs, id_col, text_col, rules).select(
        "doc", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"))
