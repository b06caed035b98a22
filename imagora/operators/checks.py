"""Validation, completeness and lineage checks; each yields rows to look at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.functions.hashing import row_digest

RUN_DEPTH = 50
DRIFT_STRICT = 1e-9
DRIFT_LOOSE = 0.02
SHA256_HEX = r"\A[0-9a-f]{64}\z"


def is_text(col: Column) -> Column:
    return F.coalesce(F.length(F.trim(col)) > 0, F.lit(False))


def is_finite(col: Column) -> Column:
    return F.coalesce(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), F.lit(False))


def is_digest(col: Column) -> Column:
    return F.coalesce(col.rlike(SHA256_HEX), F.lit(False))


def is_present(col: Column) -> Column:
    return col.isNotNull()


def json_kind(text: Column, path: str) -> Column:
    """Type of the value at a path of JSON text; null where there is none, or no JSON."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def value_rules(field: str, path: str) -> dict[str, tuple[str, Column]]:
    """Rules on one value of a JSON text: each names a type and fails where it does not hold."""
    text = F.col(field)
    kind = F.coalesce(json_kind(text, path), F.lit(""))
    number = F.try_variant_get(F.try_parse_json(text), path, "double")
    numeric = kind.rlike(r"\A(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return {
        "object": (field, F.coalesce(json_kind(text, "$").startswith("OBJECT"), F.lit(False))),
        "present": (field, is_present(json_kind(text, path))),
        "integer": (field, kind == "BIGINT"),
        "number": (field, numeric),
        "finite": (field, numeric & is_finite(number)),
        "boolean": (field, kind == "BOOLEAN"),
        "list": (field, kind.startswith("ARRAY")),
        "string": (field, kind == "STRING"),
    }


def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(key, rule, field, value) for each failed rule; rules: name -> (field, ok)."""
    found = F.array(*[
        F.when(~ok, F.struct(F.lit(name).alias("rule"), F.lit(field).alias("field"),
                             F.col(field).cast("string").alias("value")))
        for name, (field, ok) in rules.items()])
    return df.select(*key, F.explode(F.array_compact(found)).alias("_v")).select(*key, "_v.*")


def validate_run(run: DataFrame, expected: DataFrame, keys: Sequence[str],
                 depth: int = RUN_DEPTH) -> DataFrame:
    """(keys, instance_id, problem, detail) of a run against its expected instances.

    ``expected``: keys, instance_id. Checks coverage both ways, list length,
    distinct documents, dense ranks.
    """
    on = [*keys, "instance_id"]
    per = run.groupBy(*on).agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"),
        F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"))
    both = per.withColumn("_run", F.lit(True)).join(
        expected.select(*on).withColumn("_want", F.lit(True)), on, "full_outer")
    problem = F.array_compact(F.array(
        F.when(F.col("_run").isNull(), F.lit("missing")),
        F.when(F.col("_want").isNull(), F.lit("extra")),
        F.when(F.col("hits") != depth, F.lit("length")),
        F.when(F.col("docs") != F.col("hits"), F.lit("duplicate_document")),
        F.when((F.col("last") != F.col("hits")) | (F.col("ranks") != F.col("hits")), F.lit("ranks"))))
    return both.select(*on, F.explode(problem).alias("problem"),
                       F.coalesce("hits", F.lit(0)).alias("detail"))


def gold_differences(run_gold: DataFrame, expected_gold: DataFrame) -> DataFrame:
    """(instance_id, doc_id, side) of gold rows found on one side only."""
    a = run_gold.select("instance_id", "doc_id").distinct().withColumn("_a", F.lit(1))
    b = expected_gold.select("instance_id", "doc_id").distinct().withColumn("_b", F.lit(1))
    j = a.join(b, ["instance_id", "doc_id"], "full_outer")
    side = F.when(F.col("_b").isNull(), F.lit("extra")).when(F.col("_a").isNull(), F.lit("missing"))
    return j.select("instance_id", "doc_id", side.alias("side")).filter(F.col("side").isNotNull())


def metric_drift(recomputed: DataFrame, stored: DataFrame, keys: Sequence[str],
                 tolerance: float = DRIFT_STRICT) -> DataFrame:
    """(keys, stored, recomputed, drift, status): 'missing' without a stored value."""
    j = recomputed.select(*keys, F.col("value").alias("recomputed")).join(
        stored.select(*keys, F.col("value").alias("stored")), list(keys), "left")
    drift = F.abs(F.col("stored") - F.col("recomputed"))
    status = F.when(F.col("stored").isNull(), F.lit("missing")).when(
        drift > tolerance, F.lit("drift")).otherwise(F.lit("ok"))
    return j.select(*keys, "stored", "recomputed", drift.alias("drift"), status.alias("status"))


def table_digest(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(group, n, digest): order-free SHA-256 of a table's rows.

    Row digests fold into sums of their 32-bit words within 256 buckets (first
    two hex digits), which partial aggregation merges; only the 256 bucket lines
    are collected and hashed.
    """
    h = df.select(*group, row_digest(*[F.col(c) for c in cols]).alias("_h"))
    words = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    bucket = F.substring("_h", 1, 2)
    folded = h.groupBy(*group, bucket.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(w.cast("decimal(38,0)")).alias(f"_w{i}") for i, w in enumerate(words)])
    line = F.concat_ws(":", "_b", F.col("_n").cast("string"),
                       *[F.col(f"_w{i}").cast("string") for i in range(8)])
    return folded.groupBy(*group).agg(
        F.sum("_n").alias("n"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def reconcile(manifest: DataFrame, actual: DataFrame, keys: Sequence[str],
              fields: Sequence[str]) -> DataFrame:
    """(keys, field, recorded, found) where a manifest and the data disagree."""
    a = manifest.select(*keys, *[F.col(f).cast("string").alias(f"_m_{f}") for f in fields])
    b = actual.select(*keys, *[F.col(f).cast("string").alias(f"_a_{f}") for f in fields])
    j = a.join(b, list(keys), "full_outer")
    found = F.array_compact(F.array(*[
        F.when(~F.col(f"_m_{f}").eqNullSafe(F.col(f"_a_{f}")),
               F.struct(F.lit(f).alias("field"), F.col(f"_m_{f}").alias("recorded"),
                        F.col(f"_a_{f}").alias("found"))) for f in fields]))
    return j.select(*keys, F.explode(found).alias("_d")).select(*keys, "_d.*")


def stamp(run_meta: DataFrame, identity: Mapping[str, Column], cache: Mapping[str, Column]) -> DataFrame:
    """Run metadata with identity and cache structs; a stamped row is refused."""
    if "identity" in run_meta.columns or "cache" in run_meta.columns:
        raise ValueError("run metadata is stamped already")
    return run_meta.withColumn("identity", F.struct(*[c.alias(n) for n, c in identity.items()])) \
        .withColumn("cache", F.struct(*[c.alias(n) for n, c in cache.items()]))


def router_block(router: DataFrame, validation: DataFrame, fraction: float, seed: int,
                 metric: str = "nDCG@10") -> DataFrame:
    """(domain, pick, validation_metric, validation_fraction, seed, n_validation,
    validation_ids_sha256, degenerate): how a router came to its picks."""
    ids = table_digest(validation.filter("is_validation"), ["domain"], ["instance_id"])
    return router.select("domain", "pick", "degenerate").join(ids, "domain").select(
        "domain", "pick", F.lit(metric).alias("validation_metric"), F.lit(fraction).alias("validation_fraction"),
        F.lit(seed).alias("seed"), F.col("n").alias("n_validation"),
        F.col("digest").alias("validation_ids_sha256"), "degenerate")


def write_new(df: DataFrame, path: str) -> None:
    """Write that refuses to replace what is there."""
    df.write.mode("errorifexists").parquet(path)


def matrix_gaps(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem): cells that are missing, extra or present more than once."""
    have = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = expected.select(*keys).withColumn("_e", F.lit(1)).join(have, list(keys), "full_outer")
    problem = F.when(F.col("_n").isNull(), F.lit("missing")).when(
        F.col("_e").isNull(), F.lit("extra")).when(F.col("_n") > 1, F.lit("duplicate"))
    return j.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def identity_drift(meta: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(group, field, distinct_values) of fields that should hold one value."""
    counts = meta.groupBy(*group).agg(*[F.count_distinct(f).alias(f) for f in fields])
    return counts.unpivot(list(group), list(fields), "field", "distinct_values").filter(
        F.col("distinct_values") > 1)


def common_keys(rows: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """(keys, members, duplicates, min_n, supported): is a key in every member once?"""
    per = rows.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("_c"), F.min("n").alias("_n"))
    total = rows.agg(F.count_distinct(member).alias("m")).scalar()
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.col("_c") - 1).alias("duplicates"),
        F.min("_n").alias("min_n"))
    return out.withColumn("supported", (F.col("members") == total) & (F.col("duplicates") == 0)
                          & (F.col("min_n") > 0))


def restamp(meta: DataFrame, old: str, new: str, field: str = "source_revision") -> DataFrame:
    """Rows with the old revision replaced; ``action`` tells what happened to each.

    A third value is rejected and left as it is.
    """
    rev = F.col(field)
    action = F.when(rev == old, F.lit("migrated")).when(
        rev == new, F.lit("already_current")).otherwise(F.lit("rejected"))
    return meta.withColumn("action", action).withColumn(
        field, F.when(rev == old, F.lit(new)).otherwise(rev))


def restamp_evidence(meta: DataFrame, group: Sequence[str], cols: Sequence[str], old: str, new: str,
                     field: str = "source_revision") -> DataFrame:
    """(group, action, n, before_sha256, after_sha256): digests of each file before and after the restamp."""
    done = restamp(meta, old, new, field)
    before = table_digest(meta, group, cols).withColumnRenamed("digest", "before_sha256")
    after = table_digest(done, group, cols).select(*group, F.col("digest").alias("after_sha256"))
    action = done.groupBy(*group).agg(F.max("action").alias("action"))
    return before.join(after, list(group)).join(action, list(group)).select(
        *group, "action", "n", "before_sha256", "after_sha256")
