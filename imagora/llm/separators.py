"""Document boundaries in flat token files without an index.

A flat file is a run of token ids with an end-of-document id after each
document. Files are held as blocks of a fixed number of tokens; every block is
searched on its own for the separator, and a prefix scan over the block
summaries numbers the documents and stitches those that cross blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imagora.llm.common import byte_chunks, flat_bytes, stage

BLOCK_TOKENS = 1 << 18
#: Tokens of the built-in files are UTF-8 bytes; this byte is in no text.
END = 255
CHUNK_BYTES = 4 << 20
GROUP = 1 << 12


def byte_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Flat files of byte tokens, one per partition: blocks and the order of documents.

    Returns (file, block, tokens) and (file, doc_no, doc_id); the second only names
    the documents that the scan finds.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        rest, block, doc_no = np.empty(0, np.uint8), 0, 0
        kind = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()),
                          ("doc_no", pa.int64()), ("doc_id", batches_type)])

        def rows(tokens: list[bytes], first: int) -> pa.RecordBatch:
            n = len(tokens)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()),
                 pa.array(tokens, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, batches_type)], schema=kind)

        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            n = len(ids)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                     pa.array(range(doc_no, doc_no + n), pa.int64()), ids.cast(batches_type)], schema=kind)
                doc_no += n
            for start, stop in byte_chunks(column, CHUNK_BYTES):
                raw, offsets = flat_bytes(column.slice(start, stop - start))
                rest = np.concatenate([rest, np.insert(raw, offsets[1:], END)])
                full = len(rest) // block_tokens
                if full:
                    yield rows([rest[i * block_tokens:(i + 1) * block_tokens].tobytes() for i in range(full)], block)
                    block, rest = block + full, rest[full * block_tokens:]
        if len(rest):
            yield rows([rest.tobytes()], block)

    id_type = docs.schema[id_col].dataType
    batches_type = pa.int64() if id_type.typeName() in ("long", "integer", "short", "byte") else pa.string()
    spark_type = "bigint" if batches_type == pa.int64() else "string"
    source = docs.select(F.col(f"`{id_col}`").cast(spark_type), F.col(f"`{text_col}`").cast("string"))
    both = stage(source.mapInArrow(write, f"file int, block bigint, tokens binary, doc_no bigint, doc_id {spark_type}"),
                 "flat-files")
    return (both.filter("block IS NOT NULL").select("file", "block", "tokens"),
            both.filter("doc_no IS NOT NULL").select("file", "doc_no", "doc_id"))


def read_flat(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of raw little-endian .bin files; one file must fit a binary cell (2 GB)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    size = block_tokens * width
    at = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.octet_length("content") - 1) / size), F.lit(0)))
    return files.filter(F.octet_length("content") > 0).select(
        "file", F.posexplode(F.transform(at, lambda i: F.substring(
            F.col("content"), (i * size + 1).cast("int"), F.lit(size)))).alias("block", "tokens")
    ).select("file", F.col("block").cast("bigint").alias("block"), "tokens")


def scan_blocks(blocks: DataFrame, end: int, width: int) -> DataFrame:
    """(file, block, n_tokens, ends): positions of the separator in each block."""
    dtype = np.dtype(f"<u{width}")
    file_type = blocks.schema["file"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), dtype=dtype) if x.is_valid else np.empty(0, dtype)
                      for x in batch.column(2)]
            ends = [np.flatnonzero(t == end).astype(np.int32) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()),
                 pa.array(ends, pa.list_(pa.int32()))], names=["file", "block", "n_tokens", "ends"])

    return blocks.mapInArrow(scan, f"file {file_type}, block bigint, n_tokens bigint, ends array<int>")


def document_spans(blocks: DataFrame, end: int = END, width: int = 1) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed): every document of every file.

    ``n_tokens`` is without the separator; two separators in a row hold an empty
    document. Tokens after the last separator are a document that is not
    ``closed``. The prefix scan has two levels: blocks inside groups of ``GROUP``,
    then groups inside a file. Null blocks are empty. An empty table gives an empty
    result.
    """
    found = stage(scan_blocks(blocks, end, width), "block-ends").withColumn("g", F.floor(F.col("block") / GROUP))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    facts = found.select("file", "g", "block", "n_tokens", F.size("ends").alias("n_ends"), last.alias("last"))
    groups = facts.groupBy("file", "g").agg(F.sum("n_tokens").alias("gt"), F.sum("n_ends").alias("ge"))
    over_groups = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("file", "g", F.coalesce(F.sum("gt").over(over_groups), F.lit(0)).alias("t0"),
                         F.coalesce(F.sum("ge").over(over_groups), F.lit(0)).alias("e0"))
    inside = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = facts.join(base, ["file", "g"]).select(
        "file", "g", "block", "n_tokens", "n_ends",
        (F.col("t0") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("at"),
        (F.col("e0") + F.coalesce(F.sum("n_ends").over(inside), F.lit(0))).alias("doc0"), "last")
    placed = stage(placed, "block-places")
    # where the document open at a block's first token began: after the last separator before it
    ends_at = placed.withColumn("end_at", F.col("at") + F.col("last") + 1)
    carry_in = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    group_end = ends_at.groupBy("file", "g").agg(F.max("end_at").alias("ge_at"))
    group_carry = group_end.select("file", "g", F.max("ge_at").over(over_groups).alias("g_open"))
    opened = ends_at.withColumn("b_open", F.max("end_at").over(carry_in)).join(group_carry, ["file", "g"]).select(
        "file", "block", "n_tokens", "n_ends", "at", "doc0",
        F.coalesce("b_open", "g_open", F.lit(0)).cast("bigint").alias("open"))
    cut = found.select("file", "block", "ends").join(opened, ["file", "block"])
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("at") + F.element_at("ends", F.col("i")) + 1)
    closed = cut.select("file", "at", "doc0", "open", "ends", F.posexplode("ends").alias("i", "pos")).select(
        "file", (F.col("doc0") + F.col("i")).alias("doc_no"), begin.alias("start"),
        (F.col("at") + F.col("pos") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = placed.groupBy("file").agg(F.sum("n_tokens").alias("t"), F.sum("n_ends").alias("doc_no"),
                                        F.coalesce(F.max(F.col("at") + F.col("last") + 1), F.lit(0)).alias("start"))
    tail = totals.filter("t > start").select("file", "doc_no", "start", (F.col("t") - F.col("start")).alias("n_tokens"),
                                             F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file, doc_no, start, n_tokens) of the byte-token files of a table.

    Null and empty texts have 0 tokens. Repeated rows are documents of their own.
    Other columns are not read. An empty table gives an empty result.
    """
    blocks, order = byte_files(docs, id_col, text_col, block_tokens)
    spans = document_spans(blocks)
    return spans.join(order, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens")
