"""Vectors of imagined documents: centroids with the query, agreement, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagora.functions import vector as vx


def _sample_lists(samples: DataFrame, keys: Sequence[str], k: int | None) -> DataFrame:
    """One row per key with its sample vectors in index order.

    A list holds at most one vector per sample index, hence at most K.
    """
    rows = samples if k is None else samples.filter(F.col("sample_index") < k)
    return rows.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sample_index", "vec"))),
                    lambda s: s["vec"]).alias("vecs"))


def centroid_with_query(samples: DataFrame, query_vectors: DataFrame, k: int | None = None,
                        keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(keys, vec, n_samples): unit mean of the sample vectors and the query's;
    the query vector alone where no sample exists."""
    lists = _sample_lists(samples, keys, k)
    joined = query_vectors.select(*keys, "vec").join(lists, list(keys), "left")
    with_query = F.concat(F.coalesce("vecs", F.array().cast("array<array<double>>")),
                          F.array("vec"))
    return joined.select(
        *keys, vx.normalize(vx.mean_of(with_query)).alias("vec"),
        F.coalesce(F.size("vecs"), F.lit(0)).alias("n_samples"),
    ).withColumn("n_samples", F.greatest("n_samples", F.lit(0)))


def _to_k(lists: str, k) -> F.Column:
    """Vectors of the samples below ``k``, in index order."""
    return F.transform(F.filter(lists, lambda s: s["sample_index"] < k), lambda s: s["vec"])


def ks_of(k_class, ks: Sequence[int]) -> F.Column:
    """The K whose bits a class has, in the order of ``ks``."""
    return F.filter(F.array(*[F.lit(k) for k in ks]), lambda k, i: F.getbit(k_class, i) == 1)


def centroids_over_k(samples: DataFrame, query_vectors: DataFrame, ks: Sequence[int],
                     keys: Sequence[str] = ("instance_id",), shared: bool = False) -> DataFrame:
    """(k_samples, keys, vec): ``centroid_with_query`` at every K. A sample moves once, not once per K.

    ``shared``: (k_class, keys, vec), one row for all K that use the same samples of a query.
    """
    lists = samples.filter(F.col("sample_index") < max(ks)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("sample_index", "vec"))).alias("ss"))
    joined = query_vectors.select(*keys, "vec").join(lists, list(keys), "left")
    name, k = "k_samples", F.col("k_samples")
    if shared:
        # the samples of a K are among those of a larger one: as many are the same
        known = joined.withColumn("_n", F.array(*[F.coalesce(F.size(_to_k("ss", k)), F.lit(-1)) for k in ks]))
        same = [sum(F.when(F.get("_n", F.lit(i)) == F.get("_n", F.lit(j)), 1 << j).otherwise(0) for j in range(len(ks)))
                for i in range(len(ks))]
        at_k = known.withColumn("k_class", F.explode(F.array_distinct(F.array(*same)))).drop("_n")
        name, k = "k_class", F.element_at(ks_of(F.col("k_class"), ks), 1)
    else:
        at_k = joined.withColumn("k_samples", F.explode(F.array(*[F.lit(k) for k in ks])))
    used = F.coalesce(_to_k("ss", k), F.array().cast("array<array<double>>"))
    return at_k.select(name, *keys, vx.normalize(vx.mean_of(F.concat(used, F.array("vec")))).alias("vec"))


def shared_over_k(queries: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(k_class, keys, field, vec): queries (k_samples, keys, field, vec), one set for all K at which a key has the same vectors."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = queries.select("k_samples", *keys, F.struct("field", "vec").alias("path")).repartition(parts, *keys).groupBy(
        "k_samples", *keys).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    bit = sum(F.when(F.col("k_samples") == k, 1 << i).otherwise(0) for i, k in enumerate(ks))
    return sets.groupBy(*keys, "paths").agg(F.bit_or(bit).alias("k_class")).select(
        "k_class", *keys, F.explode("paths").alias("p")).select("k_class", *keys, "p.field", "p.vec")


def field_centroids_over_k(samples: DataFrame, anchors: DataFrame, ks: Sequence[int],
                           keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(k_samples, keys, field, vec): ``field_centroids`` at every K. A sample moves once, not once per K."""
    k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k_samples")
    rows = samples.filter(F.col("sample_index") < max(ks))
    counts = rows.groupBy(*keys).agg(F.collect_set("sample_index").alias("drawn")).join(
        anchors.select(*keys, F.col("vec").alias("anchor")), list(keys)).select(*keys, "drawn", "anchor", k).select(
        "k_samples", *keys, "anchor", F.size(F.filter("drawn", lambda i: i < F.col("k_samples"))).alias("n")).filter("n > 0")
    means = rows.groupBy(*keys, "field").agg(
        F.sort_array(F.collect_list(F.struct("sample_index", "vec"))).alias("ss")).select(*keys, "field", "ss", k).select(
        "k_samples", *keys, "field", _to_k("ss", F.col("k_samples")).alias("vecs")).filter(F.size("vecs") > 0).select(
        "k_samples", *keys, "field", vx.mean_of(F.col("vecs")).alias("mean"))
    return _anchored(counts, means, ["k_samples", *keys])


def field_centroids(samples: DataFrame, anchors: DataFrame, k: int | None = None,
                    keys: Sequence[str] = ("instance_id",), drawn: DataFrame | None = None) -> DataFrame:
    """(keys, field, vec) for queries that have samples.

    ``samples``: keys, sample_index, field, vec, one row per non-empty field;
    ``anchors``: keys, vec, the query in the meta space. Each field is averaged
    over the samples that have it. The query joins the meta field only, with
    the weight of one among all samples, also those without a meta text.
    ``drawn``: keys, sample_index of every sample, also those without any field
    text; a query that has only such samples keeps the query's own vector.
    """
    rows = samples if k is None else samples.filter(F.col("sample_index") < k)
    listed = samples if drawn is None else drawn
    listed = listed if k is None else listed.filter(F.col("sample_index") < k)
    counts = listed.groupBy(*keys).agg(F.count_distinct("sample_index").alias("n"))
    means = _sample_lists(rows, [*keys, "field"], None).select(
        *keys, "field", vx.mean_of(F.col("vecs")).alias("mean"))
    anchored = counts.join(anchors.select(*keys, F.col("vec").alias("anchor")), list(keys))
    return _anchored(anchored, means, keys)


def _anchored(anchored: DataFrame, means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field, vec): the query, anchored (keys, anchor, n), joins the mean of the meta field."""
    meta = anchored.join(
        means.filter(F.col("field") == "meta").drop("field"), list(keys), "left"
    ).select(
        *keys, F.lit("meta").alias("field"),
        F.when(F.col("mean").isNull(), F.col("anchor")).otherwise(
            F.zip_with("mean", "anchor",
                       lambda m, a: (m * F.col("n") + a) / (F.col("n") + F.lit(1)))
        ).alias("vec"))
    others = means.filter(F.col("field") != "meta").select(*keys, "field", F.col("mean").alias("vec"))
    return meta.unionByName(others).withColumn("vec", vx.normalize(F.col("vec")))


def agreement(samples: DataFrame, k: int | None = None,
              keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """(keys, agreement, n): mean pairwise dot product, 1.0 below two samples.

    Uses |sum|^2 = sum |x|^2 + 2 * (sum over pairs), so no pairs are formed.
    """
    lists = _sample_lists(samples, keys, k)
    n = F.size("vecs")
    total_sq = vx.bind(vx.mean_of(F.col("vecs")), lambda m: vx.dot(m, m)) * n * n
    own_sq = F.aggregate("vecs", F.lit(0.0), lambda s, v: s + vx.dot(v, v))
    return lists.select(
        *keys,
        F.when(n < 2, F.lit(1.0)).otherwise((total_sq - own_sq) / (n * (n - F.lit(1))))
        .alias("agreement"),
        n.alias("n"))
