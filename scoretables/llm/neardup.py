"""Near duplicates by an LSH forest of MinHash signatures.

A signature holds ``TREES * DEPTH`` min-hashes of a document's word shingles. Each tree sorts the signatures, read from
its own place on and around the end. Candidates are those that share the longest common prefix there: a region (all
documents with the same prefix of LEAST min-hashes) of up to REGION documents pairs them all; a fuller one is read at
the greater DEPTHS, where its parts are treated the same way, and all members of what is still full are paired with its
smallest id. Pairs whose signatures agree far too little are dropped, all others are confirmed on full sets.

Documents with equal sets are one class and take part once. Confirmation has three rounds: first each document's most
alike partners; then, of the rest, the pairs that the links found so far leave in different components; last, all pairs
of a full region of LEAST min-hashes that are still in different components, compared tile by tile inside tasks.

Defined results: null or empty texts, and texts without words, have no shingles, are linked with nothing and kept;
texts of fewer words than a shingle are one shingle; rows that repeat an id are judged as one document; rows with a
null id get a null component and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoretables.llm import graph, tables, text

TREES = 16
DEPTH = 6
LEAST = 3
#: Prefix lengths by which fuller regions are read deeper.
DEPTHS = (6, 12, 24)
REGION = 16
#: Rows, and bytes of shingles, of a tile of a full region, on average. A tile travels to every tile that it is compared
#: with, so large ones are moved less.
TILE = 1024
TILE_BYTES = 8 << 20
#: Members of a component in a region from which it has tiles of its own.
OWN = 256
#: Shingles of a block of the matrices by which two tiles are compared.
BLOCK = 4096
#: Partners of each document in the first round of confirmation.
FIRST = 3
_PERMS = TREES * DEPTH
#: A pair is dropped unchecked if its signatures agree in less than the threshold minus this. Of 96 min-hashes a pair at
#: 0.8 agrees in under 0.55 once in about 10^8 pairs, and such a pair of a full region is decided in the last round.
SLACK = 0.25


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = text.mix(np.arange(1, 2 * _PERMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seed = (seed >> np.uint64(32)).astype(np.uint32)
    return seed[:_PERMS] | np.uint32(1), seed[_PERMS:]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row's lower-cased words."""
    words = text.Words(column, text.NON_SPACE)
    hashes = words.hashes()
    return [np.unique(text.shingle_hashes(hashes[a:b], width)) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def signature(shingles: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = permutations
    out = np.full(_PERMS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        x = low[at : at + 2048]
        y = a[:, None] * x + b[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``n_shingles``, ``set_key`` (digest of the set, null if it is empty) and ``sig``."""

    def make():
        own = _permutations()

        def work(batch):
            sets = shingle_sets(batch.column("body"), width)
            return {
                "id": batch.column("id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                "sig": pa.array([signature(s, own).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
            }

        return work

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return tables.map_text(source, "id long, n_shingles long, set_key binary, sig binary", make, "body")


def _keys(reps: DataFrame, depth: int) -> DataFrame:
    """One row for each document and tree: the hash of the first ``depth`` min-hashes in the tree's order."""
    around = F.concat("sig", "sig")
    trees = F.array(*(F.xxhash64(F.lit(t), F.substring(around, 4 * DEPTH * t + 1, 4 * depth)) for t in range(TREES)))
    return reps.select("id", F.posexplode(trees).alias("tree", "key"))


def _regions(rows: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """Rows of prefixes that several documents share, with the region's size ``n`` and smallest id ``leader``."""
    sizes = tables.scratch(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1"), f"{name}_sizes", n)
    return tables.scratch(rows.join(sizes, keys), name, n)


def _neighbours(shared: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs within regions of up to REGION documents; of fuller ones all members with the smallest id."""
    small = shared.where(F.col("n") <= REGION).groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    small = small.select("ids", F.posexplode("ids").alias("i", "a")).select("a", F.explode(F.slice("ids", F.col("i") + 2, REGION)).alias("b"))
    return small.unionByName(shared.where(F.col("n") > REGION).select(F.col("leader").alias("a"), F.col("id").alias("b")))


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of classes that are prefix neighbours in some tree, and the rows ``tree``, ``key``, ``id`` of
    full regions, of whose pairs they are a part. ``reps``: a written table of id, sig."""
    region = ["tree", "key"]
    shared = _regions(_keys(reps, LEAST), region, "regions", TREES * reps.count())
    crowded = shared.where(F.col("n") > REGION).select("tree", "key", "id")
    pairs, full = _neighbours(shared, region), crowded.count()
    if full:
        around, at = F.concat("sig", "sig"), 4 * DEPTH * F.col("tree") + 1
        prefixes = F.array(*(F.xxhash64(F.lit(d), F.substring(around, at, F.lit(4 * d))) for d in DEPTHS))
        deeper = crowded.select("id", "tree").join(reps, "id").select("id", "tree", F.explode(prefixes).alias("key"))
        pairs = pairs.unionByName(_neighbours(_regions(deeper, region, "deeper", len(DEPTHS) * full), region))
    return pairs.where("a < b").distinct(), crowded


def _agreement(pairs: DataFrame) -> DataFrame:
    """``a``, ``b`` and the share ``alike`` of equal min-hashes, from their signatures."""

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, _PERMS) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((one == two).mean(axis=1))], names=["a", "b", "alike"])

    return pairs.mapInArrow(run, "a long, b long, alike double")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= threshold * union, with both counts."""
    second = texts.select(F.col("id").alias("b"), F.col("body").alias("body_b"))
    joined = pairs.select("a", "b").join(second, "b").join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")

    def make():
        def work(batch):
            ids = batch.column("a").to_pylist()
            first = [i for i, x in enumerate(ids) if i == 0 or x != ids[i - 1]]
            distinct = shingle_sets(batch.column("body_a").take(pa.array(first)), width)
            ones = np.repeat(np.arange(len(first)), np.diff([*first, len(ids)])).tolist()
            twos = shingle_sets(batch.column("body_b"), width)
            common = [len(np.intersect1d(distinct[i], t, assume_unique=True)) for i, t in zip(ones, twos, strict=True)]
            both = [len(distinct[i]) + len(t) - c for i, t, c in zip(ones, twos, common, strict=True)]
            ok = np.array([100 * c >= threshold * n for c, n in zip(common, both, strict=True)], bool)
            return {c: batch.column(c).filter(pa.array(ok)) for c in ("a", "b")} | {"common": pa.array(np.array(common, np.int64)[ok]), "total": pa.array(np.array(both, np.int64)[ok])}

        return work

    return tables.map_text(joined, "a long, b long, common long, total long", make, "body_b")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles`` (the set's hashes as bytes) of each text that has shingles."""

    def make():
        def work(batch):
            sets = shingle_sets(batch.column("body"), width)
            held = np.array([len(s) > 0 for s in sets], bool)
            return {"id": batch.column("id").filter(pa.array(held)), "shingles": pa.array([s.astype(np.uint64).tobytes() for s in sets if len(s)], pa.binary())}

        return work

    return tables.map_text(texts, "id long, shingles binary", make, "body")


class _Tile:
    """Roots, set sizes and shingles of a tile's rows; ``row`` of each shingle."""

    def __init__(self, rows):
        self.roots = np.array([r["root"] for r in rows], np.int64)
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.sizes = np.array([len(s) for s in sets])
        self.shingles, self.row = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)

    def common(self, other: _Tile) -> np.ndarray:
        """The number of shared shingles of every pair of rows: a product of incidence matrices, block by block."""
        shared = np.intersect1d(self.shingles, other.shingles)
        total = np.zeros((len(self.roots), len(other.roots)), np.float32)
        if not len(shared):
            return total
        ends = []
        for tile in (self, other):
            at = np.minimum(np.searchsorted(shared, tile.shingles), len(shared) - 1)
            inside = shared[at] == tile.shingles
            at, row = at[inside], tile.row[inside]
            order = np.argsort(at, kind="stable")
            ends.append((at[order], row[order], len(tile.roots)))
        for start in range(0, len(shared), BLOCK):
            blocks = []
            for at, row, n in ends:
                a, b = np.searchsorted(at, (start, start + BLOCK))
                block = np.zeros((n, min(BLOCK, len(shared) - start)), np.float32)
                block[row[a:b], at[a:b] - start] = 1
                blocks.append(block)
            total += blocks[0] @ blocks[1].T
        return total


def _tile_links(one: _Tile, two: _Tile, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of roots that join all components which any link between the two tiles joins."""
    common = one.common(two)
    linked = 100 * common >= threshold * (one.sizes[:, None] + two.sizes - common)
    i, j = np.nonzero(linked & (one.roots[:, None] != two.roots))
    ends = np.unique(np.stack([one.roots[i], two.roots[j]], axis=1), axis=0)
    return graph.forest(ends[:, 0], ends[:, 1])


def completed(crowded: DataFrame, roots: DataFrame, source: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links ``a``, ``b`` of components that all pairs of full regions add to ``roots``. Every pair is decided on full sets."""
    region, n = ["tree", "key"], crowded.count()
    rows = crowded.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = tables.scratch(rows, "crowded", n)
    counts = tables.scratch(rows.groupBy(*region, "root").agg(F.count("*").alias("n")), "counts", n)
    mixed = counts.groupBy(*region).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*region)
    # Members of a large component have tiles of their own, which are not compared with each other.
    kinds = counts.join(mixed, region).withColumn("kind", F.when(F.col("n") >= OWN, F.col("root").cast("string")).otherwise(""))
    rows = tables.scratch(rows.join(kinds.select(*region, "root", "kind"), [*region, "root"]), "open", n)
    wanted = tables.scratch(rows.select("id").distinct(), "wanted", n)
    sets = tables.scratch(_sets(source.join(wanted, "id", "left_semi"), width).dropDuplicates(["id", "shingles"]), "sets")
    rows = tables.scratch(rows.join(sets, "id"), "placed", n)
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("shingles")) / TILE_BYTES)).cast("int")
    rows = rows.join(tables.scratch(rows.groupBy(*region, "kind").agg(parts.alias("parts")), "parts", n), [*region, "kind"])
    rows = rows.withColumn("tile", F.concat_ws(":", "kind", F.pmod(F.xxhash64("id"), "parts")))
    tiles = tables.scratch(rows.groupBy(*region, "kind", "tile").agg(F.collect_list(F.struct("root", "shingles")).alias("rows")), "tiles")
    left = tiles.select(*region, F.col("kind").alias("kind1"), F.col("tile").alias("tile1"))
    right = tiles.select(*region, F.col("kind").alias("kind2"), F.col("tile").alias("tile2"))
    pairs = tables.scratch(left.join(right, region).where("tile1 <= tile2 and (kind1 <> kind2 or kind1 = '')"), "pairs", n)
    for side, end in (("left", 1), ("right", 2)):
        pairs = pairs.join(tiles.select(*region, F.col("tile").alias(f"tile{end}"), F.col("rows").alias(side)), [*region, f"tile{end}"])

    def run(batches):
        for batch in batches:
            for same, one, two in zip(*(batch.column(c) for c in ("same", "left", "right")), strict=True):
                first = _Tile(one.as_py())
                found = _tile_links(first, first if same.as_py() else _Tile(two.as_py()), threshold)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    # Tiles are large, so a few of them make an Arrow batch.
    return pairs.select((F.col("tile1") == F.col("tile2")).alias("same"), "left", "right").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """Per row ``id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``kept``.

    ``width``: words of a shingle; ``threshold``: per cent of intersection over union from which two texts are linked.
    """
    sigs = tables.scratch(signatures(docs, id_col, text_col, width), "signatures")
    classes = tables.scratch(sigs.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    member = sigs.join(classes, "set_key", "left").withColumn("rep", F.coalesce("rep", "id"))
    members = tables.scratch(member.select("id", "n_shingles", "rep", F.when(F.col("rep") == F.col("id"), F.col("sig")).alias("sig")), "members")
    reps = members.where("sig is not null").select("id", "n_shingles", "sig")

    pairs, crowded = candidates(reps.select("id", "sig"))
    one = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    alike = _agreement(sized.select("a", "b", "sig_a", "sig_b")).where(F.col("alike") >= threshold / 100 - SLACK)
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("alike"), "a"))
    ranked = tables.scratch(alike.withColumn("rank", rank), "ranked")
    wanted = ranked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    # As a written table its size is known: where it is small it is broadcast, and the texts are not shuffled.
    texts = tables.scratch(source.join(tables.scratch(wanted, "wanted"), "id", "left_semi"), "texts")

    links = tables.scratch(confirmed(ranked.where(F.col("rank") <= FIRST), texts, width, threshold), "links")
    roots = graph.connected(links)
    later = ranked.where(F.col("rank") > FIRST)
    for end in ("a", "b"):
        later = later.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    more = tables.scratch(confirmed(later.where("root_a <> root_b"), texts, width, threshold), "links")
    roots = roots if more.isEmpty() else graph.extended(roots, more)
    last = tables.scratch(completed(crowded, roots, source, width, threshold), "links")
    roots = roots if last.isEmpty() else graph.extended(roots, last)

    return members.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select(
        "id", "n_shingles", F.coalesce("root", "rep", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("root", "rep", "id"), F.lit(True)).alias("kept")
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    gone = near_duplicates(docs, id_col, text_col, width, threshold).where("not kept").select(F.col("id").alias(id_col))
    return docs.join(tables.scratch(gone, "gone"), id_col, "left_anti").select(*(f"`{c}`" for c in docs.columns))
