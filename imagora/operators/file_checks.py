"""Files and JSON records against a manifest: digests, byte counts, and paths that stay below their root."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ABSOLUTE = r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"


def json_digest(df: DataFrame, cols: Sequence[str]) -> Column:
    """SHA-256 of a row's canonical JSON: fields by name, nulls kept, no spaces.

    Two rows have one digest if and only if their values agree, in whatever order
    their columns stand. Maps inside are sorted by key, so they have one form as well.
    """
    def plain(name: str) -> Column:
        c = F.col(f"`{name}`")
        is_map = df.schema[name].dataType.typeName() == "map"
        return (F.map_from_entries(F.array_sort(F.map_entries(c))) if is_map else c).alias(name)

    record = F.struct(*[plain(c) for c in sorted(cols)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``root``, the path relative to it.

    A file is read by one task, as one SHA-256 needs, and is 2 GB at most; files
    spread over tasks. Names that begin with ``_`` or ``.`` are left out, and so are
    empty files, which Spark's scan skips: they count as not there.
    """
    below = re.sub(ABSOLUTE.replace("/|", ""), "", root).rstrip("/")
    below = re.sub(r"^//[^/]*", "", below)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = F.instr("path", below) + len(below) + 1
    return files.select(F.expr("path").substr(start, F.length("path")).alias("path"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def settled_path(path: Column) -> Column:
    """struct(path, outside): without empty, ``.`` and ``..`` parts; outside if it leaves its root.

    Null and absolute paths, and those with a scheme, are outside.
    """
    start = F.struct(F.array().cast("array<string>").alias("parts"),
                     F.coalesce(path.rlike(ABSOLUTE), F.lit(True)).alias("outside"))

    def step(at: Column, part: Column) -> Column:
        parts, up = at["parts"], part == ".."
        cut = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        kept = F.when(part.isin("", "."), parts).when(up, cut).otherwise(F.array_append(parts, part))
        return F.struct(kept.alias("parts"), (at["outside"] | (up & (F.size(parts) == 0))).alias("outside"))

    return F.aggregate(F.split(F.coalesce(path, F.lit("")), "/"), start, step, lambda at: F.struct(
        F.array_join(at["parts"], "/").alias("path"), at["outside"].alias("outside")))


def file_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem, recorded, found): where a manifest and the files below its root disagree.

    Both sides: (path, bytes, sha256). ``outside``: the recorded path leaves the
    root, and is not looked up. ``repeated``: recorded more than once, with the
    number. ``missing``: recorded, not there. ``unlisted``: there, not recorded.
    ``bytes``, ``sha256``: the values differ; a null recorded value differs from
    any. Paths that mean the same file are one. Empty sides give what the other
    side holds.
    """
    at = manifest.select(F.col("path").alias("told"), "bytes", "sha256", settled_path(F.col("path")).alias("at"))
    none = F.lit(None).cast("string")
    outside = at.filter("at.outside").select(
        F.col("told").alias("path"), F.lit("outside").alias("problem"), F.col("told").alias("recorded"), none.alias("found"))
    inside = at.filter("NOT at.outside").groupBy(F.col("at.path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("bytes", "sha256")).alias("m"))
    there = files.select("path", F.struct("bytes", "sha256").alias("f"))
    both = inside.join(there, "path", "full_outer")
    text = lambda c: F.col(c).cast("string")
    problem = lambda when, name, a, b: F.when(when, F.struct(
        F.lit(name).alias("problem"), a.alias("recorded"), b.alias("found")))
    met = F.col("n").isNotNull() & F.col("f").isNotNull()
    found = F.array_compact(F.array(
        problem(F.col("n") > 1, "repeated", text("n"), none),
        problem(F.col("f").isNull(), "missing", text("m.bytes"), none),
        problem(F.col("n").isNull(), "unlisted", none, text("f.bytes")),
        *[problem(met & ~F.col(f"m.{v}").eqNullSafe(F.col(f"f.{v}")), v, text(f"m.{v}"), text(f"f.{v}"))
          for v in ("bytes", "sha256")]))
    return both.select("path", F.explode(found).alias("p")).select("path", "p.*").unionByName(outside)
