"""SimHash fingerprints, links between close ones, and groups of near copies.

``link`` joins fingerprints within a radius of 2 bits without losing a pair:
fingerprints are bucketed by every pair of 16-bit blocks (two flipped bits
leave two of four blocks alone), the pivot distance tables discard pairs of a
bucket whose distances to some reference differ by more than the radius, and
the survivors are verified. Buckets of more than ``LIGHT`` fingerprints make no
pairs: their members are grouped around each fingerprint at one flipped bit,
which links exactly the same pairs through at most 65 members per group.

``near_copies`` works at a similarity of 0.8, where a radius would have to be
so wide that no bucket of fingerprint bits is selective. There min-wise keys of
the shingles propose pairs, pivot tables and the Hamming distance discard
them, a sketch discards what is far below the bound, and the shingles that the
rest have in common are counted. Members
of a bucket meet one hub first; what the hubs do not link meets in pairs, in
large buckets in cells of ``CELL`` members that count common shingles.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import content_key, small, stage
from imagora.llm.components import connected

SEED = 42
BITS = 64
BLOCK_BITS = 16
PIVOTS = 16
LIGHT = 32
CHUNK = 1 << 16

# near copies
BANDS, ROWS = 10, 3
BINS = 256
MIN_SIMILARITY = 0.8
#: Pairs whose sketches fall short by more than this are not counted: over five standard deviations.
SKETCH_SLACK = 0.14
WIDE_RADIUS = 26
CELL = 128
COLUMNS = 4096
_MASK = (1 << 64) - 1


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included.

    Fewer words are one shingle, no words none.
    """
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        runs = [b" ".join(w)]
    else:
        runs = map(b" ".join, zip(*[w[i:] for i in range(words)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set if set in over half of the hashes; zero without any. Signed 64 bits."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i:i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint of each text as a bigint."""

    @F.arrow_udf("bigint")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes((t.as_buffer().to_pybytes() if t.is_valid else b""), words))
                         for t in column.cast(pa.large_binary())], pa.int64())

    return digest(text)


def splitmix(n: int, seed: int = SEED) -> list[int]:
    """n fixed 64-bit numbers: the splitmix64 sequence from ``seed``."""
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column, pivots: int = PIVOTS) -> Column:
    """Hamming distances to the reference fingerprints."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("tinyint") for p in splitmix(pivots)])


def pivot_gap(a: Column, b: Column) -> Column:
    """Largest coordinate difference: never more than the Hamming distance."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def link(fps: DataFrame, light: int = LIGHT) -> DataFrame:
    """(a, b) that connect the same fingerprints as all pairs at 2 bits or fewer do.

    ``fps``: distinct (fp).
    """
    blocks = [((1 << BLOCK_BITS) - 1) << s for s in range(0, BITS, BLOCK_BITS)]
    masks = [signed(x | y) for x, y in combinations(blocks, 2)]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(masks)])
    banded = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    counts = stage(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "fp-buckets")
    shared = stage(banded.join(counts, ["band", "key"]), "fp-members")

    few = shared.filter(F.col("n") <= light).select("band", "key", "fp", pivot_table(F.col("fp")).alias("pv"))
    other = few.select("band", "key", F.col("fp").alias("fq"), F.col("pv").alias("pw"))
    pairs = few.join(other, ["band", "key"]).filter("fp < fq") \
        .filter(pivot_gap(F.col("pv"), F.col("pw")) <= 2) \
        .filter(hamming(F.col("fp"), F.col("fq")) <= 2).select(F.col("fp").alias("a"), F.col("fq").alias("b"))

    many = shared.filter(F.col("n") > light).select("fp").distinct()
    around = F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << i)).cast("bigint") for i in range(BITS)])
    near = many.select("fp", F.explode(F.transform(around, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    # at most 65 fingerprints lie within one bit of a centre
    stars = near.groupBy("centre").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    spokes = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(spokes).distinct()


def fingerprint_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints linked at 2 bits or fewer.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest id of the
    component. Null, empty and blank texts have fingerprint zero and are linked
    like any other. Null ids take part but name no component (a component of null
    ids has a null name). Repeated rows stay. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                             fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp")), "fingerprints")
    firsts = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-first")
    labels = connected(link(firsts.select("fp")))
    named = firsts.join(labels, firsts["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    member = stage(named.join(ids, "label").select("fp", "component_id"), "fp-component")
    return rows.join(member, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------------ near copies

def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    z = np.array(splitmix(2 * n, SEED + 1), dtype=np.uint64)
    return z[:n] | np.uint64(1), z[n:]


def min_wise(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), _MASK, dtype=np.uint64)
    for i in range(0, len(hashes), CHUNK // 4):
        h = hashes[i:i + CHUNK // 4]
        for j in range(len(mul)):
            low[j] = min(low[j], (h * mul[j] + add[j]).min())
    return low


def bin_sketch(hashes: np.ndarray) -> bytes:
    """The smallest hash of each of ``BINS`` equal ranges, as one byte; 0 marks an empty bin."""
    mixed = np.sort(hashes * np.uint64(0x9E3779B97F4A7C15))
    bins = (mixed >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = (mixed[first] >> np.uint64(16)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


SKETCH = "struct<fp: bigint, bands: array<bigint>, bins: binary>"


def sketch_column(text: Column, words: int) -> Column:
    """(fp, bands, bins) of each text over its distinct shingles; null without words."""
    mul, add = _mixers(BANDS * ROWS)

    @F.arrow_udf(SKETCH)
    def sketch(column: pa.Array) -> pa.Array:
        fps, bands, bins = [], [], []
        for t in column.cast(pa.large_binary()):
            h = np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words))
            if not len(h):
                fps.append(None), bands.append(None), bins.append(None)
                continue
            low = min_wise(h, mul, add).reshape(BANDS, ROWS)
            fps.append(fingerprint(h))
            bands.append([signed(xxhash.xxh64_intdigest(b.tobytes(), i)) for i, b in enumerate(low)])
            bins.append(bin_sketch(h))
        kind = pa.struct([("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("bins", pa.binary())])
        return pa.StructArray.from_arrays(
            [pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
            fields=list(kind))

    return sketch(text)


def similarity_column(a: Column, b: Column) -> Column:
    """Estimated share of common shingles from two bin sketches."""

    @F.arrow_udf("double")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        u = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, BINS)
        v = np.frombuffer(b"".join(y.to_pylist()), np.uint8).reshape(-1, BINS)
        either = ((u > 0) | (v > 0)).sum(axis=1)
        same = ((u == v) & (u > 0)).sum(axis=1)
        return pa.array(same / np.maximum(either, 1))

    return similar(a, b)


def jaccard_column(a: Column, b: Column) -> Column:
    """Share of common shingles of two sorted sets."""

    @F.arrow_udf("double")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(x, y):
            u, v = (np.frombuffer(c.as_buffer(), np.uint64) for c in (s, t))
            common = int((np.take(v, np.searchsorted(v, u), mode="clip") == u).sum())
            out.append(common / (len(u) + len(v) - common))
        return pa.array(out, pa.float64())

    return share(a, b)


def shingle_column(text: Column, words: int) -> Column:
    """The distinct shingle hashes of each text, sorted, eight bytes each."""

    @F.arrow_udf("binary")
    def shingles(column: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words)).tobytes()
                         for t in column.cast(pa.large_binary())], pa.binary())

    return shingles(text)


def shingles_of(docs: DataFrame, uids: DataFrame, words: int, text_col: str) -> DataFrame:
    """(uid, shingles) of the texts named by ``uids``: distinct (uid)."""
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(*content_key(text)).alias("uid"), text.alias("text"))
    named = keyed.join(small(uids), "uid", "left_semi")
    return named.select("uid", shingle_column(F.col("text"), words).alias("shingles")).groupBy("uid").agg(
        F.any_value("shingles").alias("shingles"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sorted sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    place = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    often = np.bincount(place) > 1
    place = np.where(often[place], np.cumsum(often)[place] - 1, -1)
    owner, place = owner[place >= 0], place[place >= 0]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(often.sum()), COLUMNS):
        part = slice(*np.searchsorted(place, [low, low + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[part], place[part] - low] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def cell_edges(similarity: float):
    """Links of one pair of cells, as many as it takes to connect what is similar there."""

    def run(table: pa.Table) -> pa.Table:
        uid, label = (table.column(c).to_numpy() for c in ("uid", "label"))
        a: list[int] = []
        b: list[int] = []
        if len(set(label.tolist())) > 1:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            sizes = np.array([len(x) for x in sets])
            same = common_counts(sets)
            alike = same / np.maximum(sizes[:, None] + sizes[None, :] - same, 1) >= similarity
            top = label.copy()
            for i, j in np.argwhere(np.triu(alike, 1)).tolist():
                if top[i] != top[j]:
                    a.append(uid[i]), b.append(uid[j])
                    top[top == top[j]] = top[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def rest_of_buckets(banded: DataFrame, labels: DataFrame, light: int) -> tuple[DataFrame, DataFrame]:
    """What the hubs left open: (uid, hub) pairs of small buckets, (uid, label, band, key, i, j) cells of large ones.

    Members of one label are linked already. Of a large bucket, the members of
    its largest label meet all others, and all others meet one another.
    """
    member = banded.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select(
        "uid", "band", "key", F.coalesce("label", "uid").alias("label"))
    member = stage(member, "copy-members")
    parts = member.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("band", "key").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "label")).alias("top")).filter(
            "parts > 1 AND n > 2").select("band", "key", "n", "top")
    rest = stage(member.join(small(stage(mixed, "copy-mixed")), ["band", "key"]), "copy-rest")

    few = rest.filter(F.col("n") <= light).select("band", "key", "uid", "label")
    other = few.select("band", "key", F.col("uid").alias("hub"), F.col("label").alias("h_label"))
    pairs = few.join(other, ["band", "key"]).filter("uid < hub AND label <> h_label").select("uid", "hub").distinct()

    many = rest.filter(F.col("n") > light).withColumns({
        "g1": F.ceil(F.col("top.c") / CELL), "g2": F.ceil((F.col("n") - F.col("top.c")) / CELL),
        "most": F.col("label") == F.col("top.label")})
    spot = F.xxhash64("uid", "band")
    many = many.withColumn("own", F.when(F.col("most"), F.pmod(spot, F.col("g1"))).otherwise(
        F.col("g1") + F.pmod(spot, F.col("g2"))))
    first = F.when(F.col("most"), F.col("g1")).otherwise(F.lit(0))
    cells = many.withColumn("with", F.explode(F.sequence(first, F.col("g1") + F.col("g2") - 1))).select(
        "uid", "label", "band", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    return pairs, cells


def near_copies(docs: DataFrame, words: int = 5, similarity: float = MIN_SIMILARITY, id_col: str = "doc_id",
                text_col: str = "text", light: int = LIGHT) -> DataFrame:
    """(doc_id, t0, t1, keep): groups of texts whose shingle sets are this similar.

    One row per distinct (id, text), named by the 128-bit key (t0, t1) of the
    text. ``keep`` marks the smallest id of each group (null ids last, then the
    smaller key). Texts without words are alike only if they are equal. In each
    band, members of a bucket are held against a member drawn by hash, another
    one in every band, so a group of n copies makes at most n x bands pairs.
    Members of a bucket that this leaves in different groups are then all held
    against each other: in pairs in buckets of up to ``light`` members, else in
    cells, whose number grows with the square of the members outside the largest
    group. Sketches of ``BINS`` bins only discard pairs; links rest on the counted
    shingles.
    """
    t0, t1 = content_key(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), t0.alias("t0"), t1.alias("t1"),
                       sketch_column(F.col(f"`{text_col}`"), words).alias("s"))
    seen = stage(rows, "copy-sketches")
    texts = stage(seen.groupBy("t0", "t1").agg(F.min("doc_id").alias("first"), F.any_value("s").alias("s")),
                  "copy-texts")
    uid = F.xxhash64("t0", "t1").alias("uid")
    nodes = texts.filter("s IS NOT NULL").select(uid, "s.fp", "s.bands", "s.bins")
    banded = nodes.select("uid", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("uid", F.struct(F.xxhash64("uid", "band"), "uid")).alias("hub")).filter("n > 1").drop("n")
    hubs = stage(hubs, "copy-hubs")
    pairs = banded.join(hubs, ["band", "key"]).filter("uid <> hub").select("uid", "hub").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        left = nodes.select("uid", "fp", "bins")
        right = nodes.select(F.col("uid").alias("hub"), F.col("fp").alias("h_fp"), F.col("bins").alias("h_bins"))
        both = stage(pairs, "copy-pairs").join(left, "uid").join(right, "hub")
        close = both.filter(pivot_gap(pivot_table(F.col("fp")), pivot_table(F.col("h_fp"))) <= WIDE_RADIUS) \
            .filter(hamming(F.col("fp"), F.col("h_fp")) <= WIDE_RADIUS)
        near = stage(close.withColumn("sim", similarity_column(F.col("bins"), F.col("h_bins"))).filter(
            F.col("sim") >= similarity - SKETCH_SLACK).select("uid", "hub"), "copy-near")
        ends = near.select("uid").unionByName(near.select(F.col("hub").alias("uid"))).distinct()
        sets = stage(shingles_of(docs, ends, words, text_col), "copy-shingles")
        other = sets.select(F.col("uid").alias("hub"), F.col("shingles").alias("h_shingles"))
        return near.join(sets, "uid").join(other, "hub").filter(
            jaccard_column(F.col("shingles"), F.col("h_shingles")) >= similarity).select(
                F.col("uid").alias("a"), F.col("hub").alias("b"))

    edges = stage(linked(pairs), "copy-edges")
    labels = connected(edges)
    few, cells = rest_of_buckets(banded, labels, light)
    edges = edges.unionByName(linked(few))
    cells = stage(cells, "copy-cells")
    if not cells.isEmpty():
        sets = stage(shingles_of(docs, cells.select("uid").distinct(), words, text_col), "copy-shingles")
        edges = edges.unionByName(cells.join(sets, "uid").groupBy("band", "key", "i", "j").applyInArrow(
            cell_edges(similarity), "a bigint, b bigint"))
    labels = connected(edges)
    grouped = stage(texts.select("t0", "t1", "first", uid).join(labels, F.col("uid") == F.col("node"), "left").select(
        "t0", "t1", "first", F.coalesce("label", "uid").alias("label")), "copy-groups")
    order = F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("t0"), F.col("t1"))
    best = grouped.groupBy("label").agg(F.min(order).alias("k")).select(
        F.col("k.first").alias("doc_id"), F.col("k.t0").alias("t0"), F.col("k.t1").alias("t1"))
    return stage(best, "copy-kept")
