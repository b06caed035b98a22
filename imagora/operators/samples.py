"""The table of imagined samples: keys, generation of missing ones, audits, packs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagora.functions import prompts
from imagora.functions.hashing import row_digest
from imagora.functions import text as tx
from imagora.operators import ranking

# prompt frames (sample_key, prompt, temperature) in, frames with a text column out
Client = Callable[[pd.DataFrame], pd.Series]
ATTEMPTS = 2
ERROR_EXAMPLES = 20


def sample_key(model_tag: Column, temperature: Column, template_text: Column, query: Column,
               index: Column) -> Column:
    """Content-addressed key over length-prefixed parts."""
    return row_digest(model_tag, temperature, template_text, query, index)


def sample_key_compat(model_tag: Column, temperature: Column, template_text: Column,
                      query: Column, index: Column) -> Column:
    """Key as SHA-256 of the JSON list, for reading caches keyed that way."""

    @F.pandas_udf("string")
    def run(tag: pd.Series, temp: pd.Series, tpl: pd.Series, q: pd.Series,
            i: pd.Series) -> pd.Series:
        return pd.Series([
            hashlib.sha256(json.dumps([a, b, c, d, int(e)]).encode()).hexdigest()
            for a, b, c, d, e in zip(tag, temp, tpl, q, i)])

    return run(model_tag, temperature, template_text, query, index)


def required_grid(queries: DataFrame, k: int, model: str, temperature: float = 0.7,
                  templates: dict[str, str] | None = None) -> DataFrame:
    """One row per wanted sample of every distinct query text.

    (sample_key, model_tag, temperature, template, query, sample_index, prompt)
    """
    if k < 1:
        raise ValueError("k must be positive")
    grid = (
        queries.select("query").distinct()
        .select("query", F.explode(prompts.template_rows(templates)).alias("t"))
        .select("query", "t.template", "t.template_text",
                F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"))
        .withColumn("model_tag", prompts.model_tag(F.lit(model), F.col("template_text")))
        .withColumn("temperature", F.lit(float(temperature)))
    )
    key = sample_key(F.col("model_tag"), F.col("temperature"), F.col("template_text"),
                     F.col("query"), F.col("sample_index"))
    return grid.select(
        key.alias("sample_key"), "model_tag", "temperature", "template", "query", "sample_index",
        prompts.render(F.col("template_text"), F.col("query")).alias("prompt"))


def generate_missing(grid: DataFrame, stored: DataFrame, client: Client,
                     partitions: int | None = None) -> DataFrame:
    """Rows for wanted samples not stored yet: (grid columns, text, status).

    A batch the client refuses is halved until the refused rows stand alone.
    Every sample gets one retry; one that fails twice is a row with status
    'failed' and no text, to be counted and left out of packs.
    """
    missing = grid.join(stored.select("sample_key"), "sample_key", "left_anti")
    if partitions:
        missing = missing.repartition(partitions, "sample_key")
    cols = grid.columns

    def attempt(frame: pd.DataFrame) -> pd.Series:
        try:
            return pd.Series(client(frame)).reset_index(drop=True)
        except Exception:
            if len(frame) == 1:
                return pd.Series([None], dtype=object)
            half = len(frame) // 2
            return pd.concat([attempt(frame.iloc[:half]), attempt(frame.iloc[half:])],
                             ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame = frame.reset_index(drop=True)
            text = pd.Series([None] * len(frame), dtype=object)
            for _ in range(ATTEMPTS):
                todo = text.isna()
                if todo.any():
                    got = attempt(frame[todo].reset_index(drop=True))
                    text[todo] = got.to_numpy(dtype=object)
            out = frame[cols].copy()
            out["text"] = text
            out["status"] = ["failed" if t is None else "generated" for t in text]
            yield out

    schema = missing.select(*cols).schema.add("text", "string").add("status", "string")
    return missing.select(*cols).mapInPandas(run, schema)


def audit(grid: DataFrame, stored: DataFrame) -> DataFrame:
    """(template, sample_index, expected, present, missing, empty, unreadable, complete).

    A stored row whose text is null could not be read.
    """
    have = stored.select("sample_key", "text").withColumn("_found", F.lit(True))
    rows = grid.select("sample_key", "template", "sample_index").join(have, "sample_key", "left")
    found = F.coalesce("_found", F.lit(False))
    blank = tx.is_blank(F.col("text"))
    out = rows.groupBy("template", "sample_index").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(found & F.col("text").isNotNull() & ~blank).alias("present"),
        F.count_if(~found).alias("missing"),
        F.count_if(found & blank).alias("empty"),
        F.count_if(found & F.col("text").isNull()).alias("unreadable"))
    return out.withColumn("complete", F.col("present") == F.col("expected"))


def audit_errors(grid: DataFrame, stored: DataFrame, limit: int = ERROR_EXAMPLES) -> DataFrame:
    """Up to ``limit`` failing keys per (template, sample_index)."""
    rows = grid.select("sample_key", "template", "sample_index").join(
        stored.select("sample_key", "text"), "sample_key", "left")
    bad = rows.filter(F.col("text").isNull() | tx.is_blank(F.col("text"))).drop("text")
    return ranking.top_k(bad, ["template", "sample_index"], limit, [F.asc("sample_key")])


def prefix_pack(samples: DataFrame, k: int | None = None, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(keys, template, n, texts, usable): the first k texts of each query in order, or all.

    ``usable`` is false where a sample is blank, or one of the k is absent.
    """
    rows = samples if k is None else samples.filter(F.col("sample_index") < k)
    packed = rows.groupBy(*keys, "template").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sample_index", "text"))),
                    lambda s: s["text"]).alias("texts"))
    whole = (F.size("texts") == (F.size("texts") if k is None else k)) & ~F.exists("texts", tx.is_blank)
    return packed.withColumn("n", F.size("texts")).withColumn("usable", whole)


def as_instance_packs(packs: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """One row per instance with a map template -> texts."""
    return packs.groupBy(*keys).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("template", "texts")))).alias("imaginations"))


def prefix_violations(big: DataFrame, small: DataFrame, k: int,
                      keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(keys, template, problem) where the smaller pack is no prefix of the bigger."""
    on = [*keys, "template"]
    joined = big.select(*on, F.col("texts").alias("_b")).join(
        small.select(*on, F.col("texts").alias("_s")), on, "full_outer")
    problem = (
        F.when(F.col("_b").isNull(), F.lit("extra"))
        .when(F.col("_s").isNull(), F.lit("absent"))
        .when(F.slice("_b", 1, k) != F.col("_s"), F.lit("differs")))
    return joined.select(*on, problem.alias("problem")).filter(F.col("problem").isNotNull())


def chained_digests(packs: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(keys, template, k_samples, n, digest) for every K: a digest of the first K texts of a pack.

    Each link hashes the digest before it and the length-prefixed text, so one pass
    over a pack proves the prefixes of every K, and equal digests mean equal
    texts in equal order. A pack of fewer texts ends with its last link.
    """
    link = lambda before, t: F.sha2(F.concat_ws(":", before, F.octet_length(F.coalesce(t, F.lit(""))).cast("string"),
                                                F.when(t.isNull(), F.lit("0")).otherwise(F.lit("1")), t).cast("binary"), 256)
    chain = F.aggregate("texts", F.array(F.lit("")), lambda done, t: F.concat(done, F.array(link(F.element_at(done, -1), t))))
    linked = packs.select(*keys, "template", chain.alias("_chain")).withColumn(
        "k_samples", F.explode(F.array(*[F.lit(k) for k in ks])))
    n = F.least(F.col("k_samples"), F.size("_chain") - 1)
    return linked.select(*keys, "template", "k_samples", n.alias("n"), F.get("_chain", n).alias("digest"))


def prefix_proofs(big: DataFrame, small: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(template, k_samples, same, differs, absent, extra): two tables of chained digests compared for every K."""
    on = [*keys, "template", "k_samples"]
    joined = big.select(*on, F.col("digest").alias("_b")).join(small.select(*on, F.col("digest").alias("_s")), on, "full_outer")
    return joined.groupBy("template", "k_samples").agg(
        F.count_if(F.col("_b") == F.col("_s")).alias("same"), F.count_if(F.col("_b") != F.col("_s")).alias("differs"),
        F.count_if(F.col("_s").isNull()).alias("absent"), F.count_if(F.col("_b").isNull()).alias("extra"))


def query_differences(big: DataFrame, small: DataFrame) -> DataFrame:
    """(instance_id, problem): queries absent, extra, or with another text in the smaller pack."""
    a = big.groupBy("instance_id").agg(F.min("query").alias("_b"), F.lit(True).alias("_in_b"))
    b = small.groupBy("instance_id").agg(F.min("query").alias("_s"), F.lit(True).alias("_in_s"))
    problem = (
        F.when(F.col("_in_b").isNull(), F.lit("extra"))
        .when(F.col("_in_s").isNull(), F.lit("absent"))
        .when(~F.col("_b").eqNullSafe(F.col("_s")), F.lit("query")))
    return a.join(b, "instance_id", "full_outer").select("instance_id", problem.alias("problem")).filter(
        F.col("problem").isNotNull())


def duplicate_query_report(samples: DataFrame) -> DataFrame:
    """(query, template, instances, variants): distinct sample sets per query text.

    More than one set for a text is an inconsistency. Sets are compared as
    order-free sums of row digests, so no list of a hot query is collected.
    """
    h = F.xxhash64("sample_index", "text")
    per_instance = samples.groupBy("query", "template", "instance_id").agg(
        F.sum(F.pmod(h, F.lit(1 << 31))).alias("_a"),
        F.bit_xor(h).alias("_x"), F.count(F.lit(1)).alias("_n"))
    return per_instance.groupBy("query", "template").agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_distinct("_a", "_x", "_n").alias("variants"))


def reuse_audit(wanted: DataFrame, old: DataFrame) -> DataFrame:
    """(instance_id, arm, status, reason): can an old outcome stand for a wanted one?

    Same instance and arm with an equal loaded list is reused; a different list
    is rejected; no old record needs new inference. Lists are compared as sets.
    """
    a = wanted.select("instance_id", "arm", F.array_sort("loaded").alias("_w"))
    b = old.select("instance_id", "arm", F.array_sort("loaded").alias("_o"))
    joined = a.join(b, ["instance_id", "arm"], "left")
    status = (
        F.when(F.col("_o").isNull(), F.lit("needs_inference"))
        .when(F.col("_o") == F.col("_w"), F.lit("reused_same_arm"))
        .otherwise(F.lit("rejected")))
    reason = (
        F.when(F.col("_o").isNull(), F.lit("legacy_record_missing"))
        .when(F.col("_o") == F.col("_w"), F.lit("identical_loading"))
        .otherwise(F.lit("loading_differs")))
    return joined.select("instance_id", "arm", status.alias("status"), reason.alias("reason"))


def first_occurrence(rows: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Rows of the first instance of each distinct text."""
    firsts = rows.groupBy(text).agg(F.min(F.struct(*order)).alias("_f"))
    return rows.withColumn("_f", F.struct(*order)).join(firsts, [text, "_f"]).drop("_f")


def positions_within(df: DataFrame, group: Sequence[str], order: Sequence[str],
                     name: str = "sample_index") -> DataFrame:
    """0-based position per group (a conversation, a document: bounded groups)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - F.lit(1))
