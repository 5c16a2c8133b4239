"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Tiles hold fingerprints with the same population counts of their two halves. Two fingerprints that
differ in r bits have population counts that differ by r at most, so tile pairs beyond the radius are
skipped; within a pair of tiles the same rule, over the counts of all eight bytes, skips blocks.

Where links are verified by the similarity of shingle sets, tiles hold sets of about the same size, as
sets of sizes further apart can't be similar. A pair of tiles first tells which of its documents may
have a partner; only those documents' sets are sent to it and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_skewed, pieces, settled
from .components import components

SEED = 42
#: Rows of a tile that are compared as one; larger tiles are split, so that a task's memory is bounded. Each row
#: goes to all parts of the tiles near its own, so what is shuffled grows with the square beyond this size.
TILE_ROWS = 1 << 18
#: Rows of a block within a tile.
BLOCK = 128

#: With a similarity: tiles of a range of sizes are split into so many parts of all rows, within bounds of
#: rows and of their sketches' bytes; and sets are verified in parts of so many shingles.
TILE_PARTS, LEAST_ROWS, MOST_ROWS, SKETCH_BYTES, MOST_SHINGLES = 32, 1024, 1 << 18, 64 << 20, 4_000_000
#: Ranges of sizes by the power of e.
BANDS = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # highest bit first
_PLANES = (np.arange(8) * 256)[None, :]


def hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of so many words; of the whole sequence if it is shorter; none of no words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[: -words] + 1).tolist()
    return np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without words."""
    return majority(hashes(text, words))


def majority(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero without hashes."""
    if not len(h):
        return 0
    planes = h.astype(">u8").view(np.uint8).reshape(-1, 8) + _PLANES
    seen = np.bincount(planes.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS) > len(h)).ravel()
    return int(np.packbits(bits).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each text as a signed long. Null text has no words."""

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, "text", 2 << 20):
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, "id long, fp long", run)


def _byte_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint8)).reshape(-1, 8).astype(np.int16)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of a and b (of a and itself if b is None) with at most `radius` differing bits, and how many differ.

    Both sides are sorted by the population counts of their bytes and cut into blocks; a pair of
    blocks whose ranges of counts are further apart than the radius in sum is skipped.
    """

    def blocks(fp: np.ndarray):
        counts = _byte_counts(fp)
        order = np.lexsort(counts.T[::-1])
        counts = counts[order]
        starts = np.arange(0, len(fp), block)
        return order, fp[order], np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts), starts

    if not len(a) or (b is not None and not len(b)):
        return
    one = blocks(a)
    two = one if b is None else blocks(b)
    (oa, fa, low_a, high_a, sa), (ob, fb, low_b, high_b, sb) = one, two
    for i, s in enumerate(sa.tolist()):
        gap = np.maximum(low_b - high_a[i], low_a[i] - high_b)
        near = np.flatnonzero(np.maximum(gap, 0).sum(1) <= radius)
        if b is None:
            near = near[near >= i]
        if not len(near):
            continue
        rows = (sb[near][:, None] + np.arange(block)).ravel()
        rows = rows[rows < len(fb)]
        for k in range(0, len(rows), 4096):
            part = rows[k : k + 4096]
            bits = np.bitwise_count(fa[s : s + block, None] ^ fb[part][None, :])
            x, y = np.nonzero(bits <= radius)
            bits, x, y = bits[x, y], x + s, part[y]
            if b is None:
                bits, x, y = bits[x < y], x[x < y], y[x < y]
            if len(x):
                yield oa[x], ob[y], bits


def _trees(nodes: np.ndarray, label: np.ndarray, fan: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges that keep the components of rows with the same label, as trees whose nodes have `fan` larger
    ones below them at most: chains by default. So no node has many edges; wider trees take fewer rounds to join."""
    order = np.lexsort((nodes, label))
    sorted_label = label[order]
    first = np.searchsorted(sorted_label, sorted_label)
    at = np.flatnonzero(np.arange(len(order)) > first)
    above = first[at] + (at - first[at] - 1) // fan
    return nodes[order[above]], nodes[order[at]]


def _hook(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the rows x and y are linked; a label is the smallest row of its component."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != (up := label[label])).any():
            label = up


def _forest(nodes: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Chains through the components of the links."""
    label = np.arange(len(nodes))
    for x, y, _ in links:
        label = _hook(label, x, y)
    return _trees(nodes, label)


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between nodes of `distinct` (node, fp: each once) that keep the components of all
    pairs of fingerprints with at most `radius` differing bits.

    Rows go to a tile by the population counts of their halves (at most 33 x 33 tiles; their sizes are
    all that comes to the driver), tiles of more than tile_rows rows to several chunks, and each chunk
    to the pairs of chunks that it is compared in. Every pair of rows within the radius meets.
    """
    spark = distinct.sparkSession
    half = 0xFFFFFFFF
    rows = distinct.select(
        "node", "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("p"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(half))).cast("int").alias("q"),
    )
    sizes = rows.groupBy("p", "q").count().collect()
    if not sizes:
        return spark.createDataFrame([], "a long, b long")
    chunks = spark.createDataFrame([(r["p"], r["q"], -(-r["count"] // tile_rows)) for r in sizes], "p int, q int, m int")
    near = [(dp, dq) for dp in range(-radius, radius + 1) for dq in range(-radius, radius + 1) if abs(dp) + abs(dq) <= radius]
    steps = F.array(*[F.struct(F.lit(dp).alias("dp"), F.lit(dq).alias("dq")) for dp, dq in near])
    tile = lambda p, q, c: (F.col(p) * 33 + F.col(q)).cast("long") * F.lit(1 << 32) + F.col(c)
    placed = (
        rows.join(F.broadcast(chunks), ["p", "q"])
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")))
        .select("node", "fp", tile("p", "q", "c").alias("own"), "p", "q", F.explode(steps).alias("s"))
        .select("node", "fp", "own", (F.col("p") + F.col("s.dp")).alias("p2"), (F.col("q") + F.col("s.dq")).alias("q2"))
        .join(F.broadcast(chunks.toDF("p2", "q2", "m2")), ["p2", "q2"])
        .select("node", "fp", "own", "p2", "q2", F.explode(F.sequence(F.lit(0), F.col("m2") - 1)).alias("c2"))
        .withColumn("other", tile("p2", "q2", "c2"))
        .select(F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("second"), "node", "fp")
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, ["one", "two"]):
            a, b = _forest(table.column("node").to_numpy(), _pair_links(table, radius))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "one", "two").sortWithinPartitions("one", "two").mapInArrow(pairs, "a long, b long")


def _pair_links(table: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, of a tile with itself or of its rows that aren't `second` with those that are."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    if table.column("one")[0] == table.column("two")[0]:
        yield from tile_links(fp, None, radius)
        return
    second = table.column("second").to_numpy()
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    for x, y, bits in tile_links(fp[a], fp[b], radius):
        yield a[x], b[y], bits


def by_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, from batches that are sorted by integer keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _profiles(docs: DataFrame, words: int, id_col: str, text_col: str, with_sets: bool = False) -> DataFrame:
    """(id, key, and fp, size, sketch or else shingles) of each text; key is a hash of its set of shingles."""

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, "text", 2 << 20):
            every = [hashes(t or b"", words) for t in part.column("text").cast(pa.large_binary()).to_pylist()]
            sets = [np.unique(h) for h in every]
            keys = np.array([xxhash.xxh64_intdigest(u.tobytes()) for u in sets], np.uint64).view(np.int64)
            if with_sets:
                cols = [pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))]
            else:
                fps = np.array([majority(h) for h in every], np.uint64).view(np.int64)
                cols = [pa.array(fps), pa.array([len(u) for u in sets], pa.int32()), pa.array([sketch(u, width(len(u))).tobytes() for u in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys), *cols], names=names)

    names = ["id", "key", "shingles"] if with_sets else ["id", "key", "fp", "size", "sketch"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, "id long, key long, " + ("shingles array<long>" if with_sets else "fp long, size int, sketch binary"), run)


def width(size: int) -> int:
    """Parts of a set's sketch: a power of two, so many that sets of this size that share nothing differ clearly."""
    return 1 << max(6, (size // 10).bit_length())


def sketch(shingles: np.ndarray, parts: int) -> np.ndarray:
    """How many of the hashes lie in each of so many (a power of two) equal ranges, modulo 256."""
    at = (shingles >> np.uint64(65 - parts.bit_length())).astype(np.int64)
    return np.bincount(at, minlength=parts).astype(np.uint8)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of as many parts as the shortest has."""
    parts = min(map(len, sketches))
    return np.stack([np.frombuffer(x, np.uint8).reshape(parts, -1).sum(1, dtype=np.uint8) for x in sketches])


def in_reach(x: np.ndarray, y: np.ndarray, size: np.ndarray, sketches: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of rows x and y may have the Jaccard similarity. They differ in as many elements as their
    sketches at least, and may in (1 - similarity) / (1 + similarity) of their sizes' sum: no similar pair is lost."""
    least, most = np.abs(size[x] - size[y]) * (1 + similarity), (size[x] + size[y]) * (1 - similarity) + 1e-6
    found = least <= most
    todo, step = np.flatnonzero(found), max(1, (4 << 20) // sketches.shape[1])
    for k in range(0, len(todo), step):
        some = todo[k : k + step]
        apart = sketches[x[some]] - sketches[y[some]]
        found[some] = np.minimum(apart, -apart).sum(1, dtype=np.int64) * (1 + similarity) <= most[some]
    return found


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return shared >= similarity * (len(a) + len(b) - shared)


def similar_components(sets: list[np.ndarray], links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Labels of the components of those links whose sets have the Jaccard similarity.

    Links are looked at closest first within each part; one is left out only if links that were found
    similar join its ends already. So the labels are those of all similar links.
    """
    label = np.arange(len(sets))
    size = np.array([len(u) for u in sets], np.int64)
    parts = width(int(size.min()))
    sketches = np.stack([sketch(u, parts) for u in sets])
    for x, y, bits in links:
        by = np.argsort(bits, kind="stable")
        x, y = x[by], y[by]
        for k in range(0, len(x), 2048):
            i, j = x[k : k + 2048], y[k : k + 2048]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            near = in_reach(i, j, size, sketches, similarity)
            for i, j in zip(i[near].tolist(), j[near].tolist(), strict=True):
                p, q = label[i], label[j]
                if p != q and similar(sets[i], sets[j], similarity):
                    label[label == max(p, q)] = min(p, q)
    return label


def similar_links(groups: DataFrame, docs: DataFrame, words: int, radius: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between nodes of `groups` (key, node, fp, size, sketch: each key once) that keep the components
    of all pairs with at most `radius` differing bits and sets of at least the similarity.

    Rows go to a tile by the power of their set's size, large tiles to several chunks, and each chunk to the
    pairs of chunks whose sizes may be similar. First each pair of chunks tells the rows that have a partner
    in reach by bits, sizes and sketches, then it gets those rows' sets and verifies, in pairs of parts if
    there are many. Neither sends pairs of rows, so a group of near copies costs its size, and bits and sets
    are compared within tasks only.
    """
    spark = groups.sparkSession
    rows = groups.withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) * BANDS).cast("int"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.octet_length("sketch")).alias("m")).collect()
    if not sizes:
        return spark.createDataFrame([], "a long, b long")
    tile_rows = min(MOST_ROWS, max(LEAST_ROWS, sum(r["n"] for r in sizes) // TILE_PARTS))
    chunks = spark.createDataFrame([(r["band"], max(-(-r["n"] // tile_rows), -(-r["m"] // SKETCH_BYTES))) for r in sizes], "band int, m int")
    reach = int(-np.log(similarity) * BANDS) + 1
    tile = lambda band, c: F.col(band).cast("long") * F.lit(1 << 32) + F.col(c)
    placed = (
        rows.join(F.broadcast(chunks), "band")
        .withColumn("c", F.pmod(F.xxhash64("key"), F.col("m")))
        .withColumn("own", tile("band", "c"))
        .withColumn("band2", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach)))
        .join(F.broadcast(chunks.toDF("band2", "m2")), "band2")
        .withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("m2") - 1)))
        .withColumn("other", tile("band2", "c2"))
        .select(F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("second"), "key", "node", "fp", "size", "sketch")
    )

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, ["one", "two"]):
            size = table.column("size").to_numpy().astype(np.int64)
            sketches = folded(table.column("sketch").to_pylist())
            found = np.zeros(len(size), bool)
            for x, y, _ in _pair_links(table, radius):
                new = ~(found[x] & found[y])
                x, y = x[new], y[new]
                near = in_reach(x, y, size, sketches, similarity)
                found[x[near]] = found[y[near]] = True
            if found.any():
                yield from table.select(["one", "two", "second", "key", "node", "fp", "size"]).filter(pa.array(found)).to_batches()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_keys(batches, ["one", "two", "sub"]):
            sets = [u for c in table.column("shingles").chunks for u in np.split(c.flatten().to_numpy().view(np.uint64), (c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py()))]
            a, b = _trees(table.column("node").to_numpy(), similar_components(sets, _pair_links(table, radius), similarity), fan=16)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *keys: df.repartition(n, *keys).sortWithinPartitions(*keys)
    near = settled(dealt(placed, "one", "two").mapInArrow(partnered, "one long, two long, second boolean, key long, node long, fp long, size int"))
    parts = near.groupBy("one", "two").agg(F.ceil(F.sum("size") / MOST_SHINGLES).alias("m")).withColumn("m", F.greatest("m", F.lit(1)))
    split = near.join(parts, ["one", "two"]).withColumn("c", F.pmod(F.xxhash64("key"), "m")).withColumn("c2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    split = split.withColumn("sub", F.least("c", "c2") * F.col("m") + F.greatest("c", "c2"))
    needed = near.select("key", "node").distinct()
    own = docs.join(needed.select(F.col("node").alias("need")), docs[id_col] == F.col("need"), "left_semi")
    sets = _profiles(own, words, id_col, text_col, with_sets=True).dropDuplicates(["key"]).select("key", "shingles")
    return dealt(split.join(sets, "key").select("one", "two", "sub", "second", "node", "fp", "shingles"), "one", "two", "sub").mapInArrow(verified, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None, similarity: float = 0.8
) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most `radius` bits.

    With `wide`, texts are linked instead if their sets of shingles have at least the Jaccard similarity and
    their fingerprints at most that many differing bits; every such link is verified, also those of up to
    `radius` bits and of equal fingerprints. Texts with the same set of shingles meet first.

    Texts without words, and null texts, have fingerprint zero and are linked like any other. Rows with
    the same id count as one document; a row with a null id takes its fingerprint's component (null if
    no row with that fingerprint has an id). Copies meet by equal fingerprints first, so a group of
    copies costs one node. A long text is hashed whole, by itself: a task holds its words and their hashes.
    """
    if wide is not None:
        rows = settled(_profiles(docs, words, id_col, text_col))
        first = [F.first(c).alias(c) for c in ("fp", "size", "sketch")]
        groups = settled(rows.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("n"), *first))
        edges = similar_links(groups.where("node is not null").drop("n"), docs, words, wide, similarity, id_col, text_col)
        known = groups.join(components(edges), "node", "left").select("key", F.coalesce("root", "node").alias("component"), "n")
        return join_skewed(rows.select("id", "fp", "key"), known, "key", "n", rows.count()).select("id", "fp", "component")
    fps = settled(fingerprints(docs, words, id_col, text_col))
    groups = settled(fps.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    found = components(links(groups.where("node is not null").select("node", "fp"), radius))
    known = groups.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component"), "n")
    return join_skewed(fps, known, "fp", "n", fps.count())


def one_of_each(
    docs: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None, similarity: float = 0.8
) -> DataFrame:
    """The row of each component's smallest id, with its columns; of several rows with that id one stays.

    Rows with a null id can't be told apart and all stay.
    """
    found = near_duplicates(docs, words, radius, id_col, text_col, wide, similarity)
    gone = settled(found.where("component <> id").select("id").distinct())
    left = docs.join(gone, docs[id_col] == gone["id"], "left_anti")
    again = settled(found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return left
    once = left.join(again, left[id_col] == again["id"], "left_anti")
    return once.unionByName(left.join(again, left[id_col] == again["id"], "left_semi").dropDuplicates([id_col]))
