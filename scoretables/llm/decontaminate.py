"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Normalised words are runs of 0-9, a-z (after lower-casing A-Z) and characters from U+0080 on. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window. Every window whose hash is found is
verified word by word and byte by byte before it counts. A document word inside any occurrence of a window is hit.

Defined results: null or empty texts have no words and are clean; null items, items without words and items with a
null id are ignored; repeated items count once; repeated documents are judged each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretables.llm import tables, text

WINDOW = 13
#: Bytes of benchmark text in one broadcast index; a larger benchmark is scanned in blocks of this size.
INDEX_BYTES = 16 << 20
_HIT = "n_words long, hits array<struct<start:int,stop:int>>, items array<string>"


class Index:
    """Windows of a block of items, as numpy arrays: the vocabulary, and for each length the hashed word-id windows."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        words = text.Words(pa.array([t for _, t in items], pa.large_string()), text.ALNUM)
        hashes = words.hashes()
        self.vocab, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        at, end = words.starts[first], words.ends[first]
        self.size = end - at
        self.place = np.concatenate([[0], np.cumsum(self.size)])
        self.letters = np.concatenate([words.data[a:b] for a, b in zip(at, end, strict=True)] or [np.zeros(0, np.uint8)])
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[words.bounds[k] : words.bounds[k + 1]].tolist()
            length = min(n, len(own))
            for i in range(len(own) - length + 1) if own else ():
                found.setdefault(length, {}).setdefault(tuple(own[i : i + length]), set()).add(item)
        self.by_length = {}
        for length, windows in found.items():
            grid, names = np.array(list(windows), np.int64), list(windows.values())
            key = self._key([grid[:, j] for j in range(length)])
            order = np.argsort(key, kind="stable")
            self.by_length[length] = key[order], grid[order], [sorted(names[i]) for i in order]

    @staticmethod
    def _key(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = text.mix(out + c.astype(np.uint64) + np.uint64(1))
        return out

    def _same_bytes(self, words: text.Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each word whether its bytes are those of its vocabulary entry."""
        ok = (words.ends[at] - words.starts[at]) == self.size[ids]
        at, ids = at[ok], ids[ok]
        if len(at):
            size = self.size[ids]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = words.data[np.repeat(words.starts[at], size) + step] == self.letters[np.repeat(self.place[ids], size) + step]
            ok[np.flatnonzero(ok)] = np.logical_and.reduceat(same, np.cumsum(size) - size)
        return ok

    def scan(self, column: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Word counts; by row the hit word ranges and the items with occurring windows."""
        words = text.Words(column, text.ALNUM)
        counts = np.diff(words.bounds)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not len(words.starts) or not len(self.vocab):
            return counts, spans, items
        hashes = words.hashes()
        ids = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        known = self.vocab[ids] == hashes
        stops = np.where(known, len(ids), np.arange(len(ids)))
        room = np.minimum.accumulate(stops[::-1])[::-1]
        room = np.minimum(room, np.repeat(words.bounds[1:], counts)) - np.arange(len(ids))
        for length, (key, grid, names) in self.by_length.items():
            at = np.flatnonzero(room >= length)
            if not len(at):
                continue
            own = self._key([ids[at + j] for j in range(length)])
            low, high = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            hit = np.flatnonzero(high > low)
            at, low, high = at[hit], low[hit], high[hit]
            for tie in range(int((high - low).max(initial=0))):
                pick = np.flatnonzero(low + tie < high)
                start, window = at[pick], low[pick] + tie
                pos = start[:, None] + np.arange(length)
                same = (ids[pos] == grid[window]).all(axis=1)
                start, window, pos = start[same], window[same], pos[same]
                same = self._same_bytes(words, pos.ravel(), ids[pos].ravel()).reshape(-1, length).all(axis=1)
                rows = np.searchsorted(words.bounds, start[same], "right") - 1
                for row, s, w in zip(rows.tolist(), start[same].tolist(), window[same].tolist(), strict=True):
                    s -= int(words.bounds[row])
                    spans.setdefault(row, []).append((s, s + length))
                    items.setdefault(row, set()).update(names[w])
        return counts, {k: _merged(v) for k, v in spans.items()}, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, body: str, index_bytes: int, n: int):
    """Indexes of at most ``index_bytes`` of text each, built one after the other on the driver."""
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(body).alias("body")).where("id is not null and body is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-total // index_bytes))
    for k in range(parts):
        block = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == k) if parts > 1 else items
        yield parts, Index([(r.id, r.body) for r in block.toLocalIterator()], n)


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """For each document, ``row`` (all its columns, as a struct), ``n_words``, ``hits`` (word ranges) and ``items``.

    The benchmark is broadcast as a hash set if its text is at most ``index_bytes``. Beyond, documents are scanned once
    for each block of the benchmark and the ranges of a document are united.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    blocks = _blocks(benchmark, item_col, item_text, index_bytes, n)

    def scanned(df: DataFrame, index: Index) -> DataFrame:
        held = spark.sparkContext.broadcast(index)

        def make():
            own = held.value

            def work(batch):
                counts, spans, items = own.scan(batch.column("body"))
                rows = range(batch.num_rows)
                ranges = pa.array([[{"start": a, "stop": b} for a, b in spans.get(i, ())] for i in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                keep = {c: batch.column(c) for c in batch.schema.names if c != "body"}
                return keep | {"n_words": pa.array(counts, pa.int64()), "hits": ranges, "items": pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string()))}

            return work

        key = [c for c in df.columns if c == "key"]
        return tables.map_text(df.select("row", *key, F.col("row")[text_col].alias("body")), f"row {kind}, {'key long, ' if key else ''}{_HIT}", make, "body")

    parts, index = next(blocks)
    if parts == 1:
        return scanned(packed, index)
    packed = tables.scratch(packed.withColumn("key", F.monotonically_increasing_id()), "scan")
    marks = lambda df: df.where(F.size("hits") > 0).select("key", "hits", "items")  # noqa: E731  few and short beside the documents
    first = tables.scratch(scanned(packed, index), "scanned")
    found = marks(first)
    for _, index in blocks:
        found = found.unionByName(marks(scanned(packed, index)))
    found = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = first.select("row", "key", "n_words", F.slice("hits", 1, 0).alias("none"), F.slice("items", 1, 0).alias("nothing")).join(tables.scratch(found, "marks"), "key", "left")
    found = found.select("row", "key", "n_words", F.coalesce("hits", "none").alias("hits"), F.coalesce("items", "nothing").alias("items"))
    united = """aggregate(hits, cast(array() as array<struct<start:int,stop:int>>), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).stop,
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(x.stop, element_at(acc, -1).stop)))), concat(acc, array(x))))"""
    return found.withColumn("hits", F.expr(united)).drop("key")


def judged(found: DataFrame) -> DataFrame:
    """``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (hit, and one word in twenty at least) from hits()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    out = found.withColumn("n_hit", n_hit)
    return out.withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    })


def without_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return judged(hits(docs, benchmark, **how)).where(~F.col("contaminated")).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """All documents; from hit texts the bytes from each range's first word to its last are removed."""
    found = hits(docs, benchmark, text_col=text_col, **how)

    def make():
        def work(batch):
            out = []
            bodies = batch.column("body")
            words = text.Words(bodies, text.ALNUM)
            for i, spans in enumerate(batch.column("hits").to_pylist()):
                body = bodies[i].as_py()
                if spans:
                    data, base, first = body.encode(), int(words.offsets[i]), int(words.bounds[i])
                    for s in reversed(spans):
                        data = data[: int(words.starts[first + s["start"]]) - base] + data[int(words.ends[first + s["stop"] - 1]) - base :]
                    body = data.decode()
                out.append(body)
            return {"row": batch.column("row"), "body": pa.array(out, pa.string())}

        return work

    kind = found.schema["row"].dataType.simpleString()
    cut = tables.map_text(found.select("row", "hits", F.col("row")[text_col].alias("body")), f"row {kind}, body string", make, "body")
    return cut.select(*(F.col("body").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def items_digest(items: list[str]) -> str:
    """The digest that judged() gives for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
