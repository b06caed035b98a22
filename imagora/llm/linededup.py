"""Line de-duplication over levelled sorted runs of line hashes.

A run is a table (h, g, n_docs, max_doc) sorted by the 128-bit hash (h, g) of
a line key. Each batch of documents adds a run to level 0; a level that holds
``fanout`` runs is merged into one run of the next level, so k batches leave
O(log k) runs to merge-join against.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import LOWER, UPPER, content_key, stage

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, id_col: str, text_col: str, batches: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, doc, r0, r1, pos, h, g): one row per line that can be dropped.

    (doc, r0, r1) names a row by id and content; rows of one id share a batch.
    """
    text = F.col(f"`{text_col}`")
    r0, r1 = content_key(text)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), r0.alias("r0"), r1.alias("r1"),
                       F.posexplode(split_lines(text)).alias("pos", "line"))
    keyed = rows.select(F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"), "doc", "r0", "r1", "pos",
                        line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    h, g = content_key(F.col("key"))
    return keyed.select("batch", "doc", "r0", "r1", "pos", h.alias("h"), g.alias("g"))


class LineRuns:
    """Sorted runs of line hashes, level by level, in the shared folder."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def merge(runs: list[DataFrame]) -> DataFrame:
        """One table of totals; a document must not be in two runs."""
        return reduce(DataFrame.unionByName, runs).groupBy("h", "g").agg(
            F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add the run of one batch of (doc, h, g), then merge the levels that are full."""
        run = lines.select("h", "g", "doc").distinct().groupBy("h", "g").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("max_doc"))
        self._put(0, run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self.merge(full))
            level += 1

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stage(run.sortWithinPartitions("h", "g"), f"line-run-{level}"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines of a new batch that no run holds: the first-copy-stays rule of a stream."""
        if not self.runs():
            return lines
        return lines.join(self.merge(self.runs()), ["h", "g"], "left_anti")

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h, g, max_doc) of the keys in ``min_docs`` documents or more."""
        return self.merge(self.runs()).filter(F.col("n_docs") >= min_docs).select("h", "g", "max_doc")


def dropped_positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, r0, r1, n_dropped, drop): a bitmap of 64 lines per map entry.

    A hot line is one key of a plain join of two tables, which can be split; the
    bits of a document are put together from partial results.
    """
    hit = lines.join(repeated, ["h", "g"]).filter(~F.col("doc").eqNullSafe(F.col("max_doc")))
    words = hit.groupBy("doc", "r0", "r1", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc", "r0", "r1").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document with its remaining lines.

    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more
    lose all lines but those of the largest id. Null and empty texts are one empty
    line, which stays. Rows of one id count as one document; repeated rows give
    repeated results. A null id is smaller than any other. Other columns are not
    read. An empty table gives an empty result.
    """
    lines = stage(long_lines(docs, id_col, text_col, batches, min_chars), "lines", "batch")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    repeated = stage(runs.repeated(min_docs), "repeated-lines")
    drops = dropped_positions(lines.drop("batch"), repeated)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    r0, r1 = content_key(text)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), r0.alias("q0"), r1.alias("q1"))
    both = rows.join(drops, rows["doc_id"].eqNullSafe(drops["doc"]) & (rows["q0"] == drops["r0"])
                     & (rows["q1"] == drops["r1"]), "left")
    kept = F.filter("lines", lambda _, i: F.coalesce(
        F.getbit(F.element_at("drop", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(0)) == 0)
    return both.withColumn("lines", split_lines(F.col("text"))).select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"))
