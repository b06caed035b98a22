"""Seeded validation splits and samples by domain."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imagora.operators import ranking

VAL_FRACTION = 0.2
VAL_SEED = 0


def validation_split(ids: DataFrame, group: Sequence[str] = ("domain",),
                     fraction: float = VAL_FRACTION, seed: int = VAL_SEED) -> DataFrame:
    """(group, instance_id, is_validation): the first max(1, int(fraction * n))
    ids of each group in seeded hash order are the validation part."""
    ranked = ranking.hashed_rank(ids, group, ["instance_id"], seed)
    size = F.greatest(F.lit(1), F.floor(F.col("group_n") * F.lit(fraction)))
    return ranked.select(*group, "instance_id", (F.col("draw_rank") < size).alias("is_validation"))


def validation_split_compat(ids: DataFrame, fraction: float = VAL_FRACTION,
                            seed: int = VAL_SEED) -> DataFrame:
    """The split drawn by Python's generator over each domain's sorted ids.

    Only positions are drawn in Python, from each domain's size; ids are ranked
    by Spark. One domain's ids are sorted together, so this is for replaying
    published splits, not for domains beyond what one sort should hold.
    """
    ranked = ids.select("domain", "instance_id", (F.row_number().over(
        Window.partitionBy("domain").orderBy("instance_id")) - F.lit(1)).alias("pos"))
    sizes = ids.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))

    def positions(batches):
        for pdf in batches:
            for domain, n in zip(pdf["domain"], pdf["n"]):
                take = max(1, int(n * fraction))
                yield pd.DataFrame(
                    {"domain": domain, "pos": random.Random(seed).sample(range(int(n)), take)})

    drawn = sizes.mapInPandas(positions, "domain string, pos int").withColumn(
        "is_validation", F.lit(True))
    return ranked.join(drawn, ["domain", "pos"], "left").select(
        "domain", "instance_id", F.coalesce("is_validation", F.lit(False)).alias("is_validation"))
