"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Every word has hashed embeddings side by side: of the whole word and of its first bytes, for inflected and compound
forms that are too rare to be learned one by one. Filters of several widths run over them, each is pooled by its
maximum over the whole text, and the rectified maxima go to a logistic layer. Everything starts from noise.

Rows set apart from training (a quarter, by a hash of their key) choose the threshold of each language (as identified
from the text by a model the caller gives) that balances misses and false alarms; scores are stretched so that this
threshold becomes 0.5. A language with fewer than ENOUGH rows of either label takes the threshold of all. Languages are
told only for texts whose score lies between the least and the greatest threshold. Maxima run on from piece to piece of
a long text.

The model learns from all labelled rows: three quarters train, a quarter is counted for the thresholds. Texts become
bucket numbers where they lie and are dealt into shards of about SHARD_BYTES. In each of ROUNDS rounds every shard goes
on from the same network through its next rows; what the shards changed is added up by blocks of parameters and averaged,
each parameter over the shards that moved it. Only the network and counts of scores come to the driver. Defined results:
null and empty texts have one word of padding and are scored like others; repeated rows are scored each; of several
labels of a document the largest counts; without rows of both labels every score is the share of label 1 (0 if there is
none). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoretables.llm import langid, tables, text, urlfilter

#: Bytes of a word that each of its embeddings is hashed from; None: all.
STARTS = (None, 4)
#: Bucket numbers fit into 16 bits.
BUCKETS, SIZE = 1 << 15, 8
WIDTHS, FILTERS = (1, 2, 3), 8
#: Bytes of bucket numbers that are trained on at a time, and rounds of averaging.
SHARD_BYTES, ROUNDS = 16 << 20, 8
#: A shard takes so many steps in all, and more if its rows would not be met EPOCHS times.
STEPS, EPOCHS, BATCH, RATE = 800, 3, 64, 0.1
#: Parameters whose changes make a row.
BLOCK = 1 << 13
#: Scores are counted in cells of 1 / CELLS of a logit.
CELLS = 64
#: Where Adagrad's sums of squared gradients start: small, so that first steps are long.
SEEN = 1e-6
ENOUGH = 20
#: Words of a text that are scored at a time.
PIECE = 1 << 16
SEED = 5


class Texts:
    """Word buckets of several texts in one flat array, with a padding word (bucket 0) at the end of each text."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        words = text.Words(column, text.ALNUM)
        bounds = words.bounds + np.arange(len(words.bounds))
        ids = np.zeros((len(STARTS), bounds[-1]), np.uint16)
        at = np.arange(len(words.starts)) + words.rows()
        for own, first in zip(ids, STARTS, strict=True):
            own[at] = words.hashes(first) % np.uint64(BUCKETS - 1) + np.uint64(1)
        return cls(ids, bounds)

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(self.ids[:, a:b]).tobytes() for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    @classmethod
    def unpacked(cls, rows: list[bytes]) -> Texts:
        parts = [np.frombuffer(x, np.uint16).reshape(len(STARTS), -1) for x in rows]
        return cls(np.concatenate(parts, axis=1), np.cumsum([0, *(p.shape[1] for p in parts)]))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one after the other, and where each begins."""
        size = np.diff(self.bounds)[rows]
        starts = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(starts - self.bounds[rows], size)
        return self.ids[:, at], starts


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.embed = rng.normal(0, 0.3, (len(STARTS), BUCKETS, SIZE)).astype(np.float32)
        self.embed[:, 0] = 0
        self.filters = [rng.normal(0, 0.3, (w, len(STARTS) * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.out_bias = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32)
        self.seen = {id(p): np.full_like(p, SEEN) for p in (self.embed, *self.filters, *self.bias, self.out, self.out_bias)}

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """All parameters, and the sums of squared gradients of each, one after the other."""
        own = self._parameters()
        return np.concatenate([p.ravel() for p in own]), np.concatenate([self.seen[id(p)].ravel() for p in own])

    @classmethod
    def of(cls, values: np.ndarray, seen: np.ndarray) -> Network:
        made, at = cls(), 0
        for p in made._parameters():
            p[...], made.seen[id(p)][...] = (x[at : at + p.size].reshape(p.shape) for x in (values, seen))
            at += p.size
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def _down(self, value: np.ndarray, gradient: np.ndarray, rate: float, at=...) -> None:
        """One step of Adagrad on ``value[at]``."""
        seen = self.seen[id(value)]
        seen[at] += gradient**2
        value[at] -= rate * gradient / np.sqrt(seen[at])

    def values(self, ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of all words of ``ids``, and filter values of the windows that begin at the first ``len(left)`` of
        them. ``left``: words from each to its text's end; a window past that sees padding only."""
        x = np.concatenate([e[i] for e, i in zip(self.embed, ids, strict=True)], axis=1)
        n = len(left)
        values = np.empty((n, len(WIDTHS) * FILTERS), np.float32 if x.dtype == np.float32 else float)
        for i, (width, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
            y = x[:n] @ f[0] + b
            for k in range(1, width):
                more = x[k : n + k] @ f[k]
                y[: len(more)] += more * (left[: len(more), None] > k)
            values[:, i * FILTERS : (i + 1) * FILTERS] = y
        return x, values

    def maxima(self, ids: np.ndarray, starts: np.ndarray):
        """Embeddings, words left to each text's end, filter values, and of each text the maximum of every filter."""
        sizes = np.append(starts[1:], ids.shape[1]) - starts
        last = np.repeat(starts + sizes, sizes) - np.arange(ids.shape[1])
        x, values = self.values(ids, last)
        return x, last, values, np.maximum.reduceat(values, starts)

    def tops(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each text the maximum of every filter over all its words, PIECE words at a time."""
        n = ids.shape[1]
        ends = np.append(starts[1:], n)
        out = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, self.embed.dtype)
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            texts = np.arange(np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b - 1, "right"))
            begins = np.maximum(starts[texts], a) - a
            left = np.repeat(ends[texts] - a, np.diff(np.append(begins, b - a))) - np.arange(b - a)
            values = self.values(ids[:, a : b + max(WIDTHS) - 1], left)[1]
            out[texts] = np.maximum(out[texts], np.maximum.reduceat(values, begins))
        return out

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        top = np.maximum(self.tops(ids, starts), 0)
        return 1 / (1 + np.exp(-(top @ self.out + self.out_bias).astype(float)))

    def step(self, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the logistic loss. Only the first place of each maximum passes a gradient on."""
        x, last, values, top = self.maxima(ids, starts)
        pools = np.maximum(top, 0)
        error = (1 / (1 + np.exp(-(pools @ self.out + self.out_bias))) - y).astype(x.dtype) / len(y)
        back = error[:, None] * self.out * (top > 0)
        text_of = np.repeat(np.arange(len(starts)), np.append(starts[1:], len(x)) - starts)
        order = np.where(values == top[text_of], np.arange(len(x))[:, None], len(x))
        places = np.minimum.reduceat(order, starts)
        rows, parts = [], []
        for i, (width, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            to_f = np.zeros_like(f)
            for j in range(FILTERS):
                at, g = places[:, own.start + j], back[:, own.start + j]
                for k in range(width):
                    ok = (g != 0) & (last[at] > k)
                    rows.append(at[ok] + k)
                    parts.append(g[ok][:, None] * f[k, :, j])
                    to_f[k, :, j] = g[ok] @ x[at[ok] + k]
            self._down(f, to_f, rate)
            self._down(b, back[:, own].sum(axis=0), rate)
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        for h in range(len(STARTS)):
            own, inverse = np.unique(ids[h][rows], return_inverse=True)
            gradient = np.zeros((len(own), SIZE), x.dtype)
            np.add.at(gradient, inverse, parts[:, h * SIZE : (h + 1) * SIZE])
            self._down(self.embed, gradient, rate, (h, own))
        self.embed[:, 0] = 0
        self._down(self.out, error @ pools, rate)
        self._down(self.out_bias, error.sum(keepdims=True), rate)


class Model:
    """``thresholds``: by language, at None that of all others."""

    def __init__(self, network: Network | None, share: float, languages: langid.Model | None, thresholds: dict[str | None, float]):
        self.network, self.share, self.languages, self.thresholds = network, share, languages, thresholds

    def score(self, column: pa.Array) -> np.ndarray:
        if self.network is None or not len(column):
            return np.full(len(column), self.share)
        texts = Texts.of(column)
        raw = self.network.score(texts.ids, texts.bounds[:-1])
        low, high = min(self.thresholds.values()), max(self.thresholds.values())
        # Only where thresholds disagree does the language matter; elsewhere it need not be told.
        between = np.flatnonzero((raw >= low) & (raw < high))
        cut = np.full(len(raw), low)
        if self.languages and len(between):
            known = np.array([self.thresholds.get(x, self.thresholds[None]) for x in [*self.languages.languages, None]])
            cut[between] = known[self.languages.predict(column.take(pa.array(between)))[0]]
        return stretched(raw, low, cut, high)


def stretched(raw: np.ndarray, low: float, cut: np.ndarray, high: float) -> np.ndarray:
    """Scores on a line of four straight parts through (0, 0), (low, 0.25), (cut, 0.5), (high, 0.75) and (1, 1).

    ``low`` and ``high`` are the least and greatest threshold, ``cut`` that of the row's language; parts without length
    fall out, so a score reaches 0.5 exactly where ``raw`` reaches ``cut``.
    """
    part = lambda a, b: np.clip((raw - a) / np.maximum(b - a, 1e-12), 0, 1)
    return np.where(raw < low, 0.25 * part(0, low), np.where(raw < cut, 0.25 + 0.2499 * part(low, cut), np.where(raw < high, 0.5 + 0.25 * part(cut, high), 0.75 + 0.25 * part(high, 1))))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that leaves the fewest errors, each label's errors weighted by its rows."""
    order = np.argsort(p, kind="stable")
    return _cut(p[order], p[order], 1 - y[order], y[order])


def _cut(low: np.ndarray, high: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """The same of cells in order, with their least and greatest score and their rows of either label."""
    misses = np.concatenate([[0], np.cumsum(n1)]) / max(n1.sum(), 1)
    alarms = 1 - np.concatenate([[0], np.cumsum(n0)]) / max(n0.sum(), 1)
    cost = misses + alarms
    below, above = np.concatenate([[0.0], high]), np.concatenate([low, [1.0]])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    widest = best[np.argmax((above - below)[best])]
    return float(np.clip((below[widest] + above[widest]) / 2, 1e-6, 1 - 1e-6))


def _learn(network: Network, texts: Texts, y: np.ndarray, shard: int, turn: int) -> None:
    """A round's steps on a shard. Of either label half a batch, in shuffled order and over again: all rows are met."""
    rng = np.random.default_rng([SEED, shard])
    by_label = [w for w in (np.flatnonzero(y == k) for k in (0, 1)) if len(w)]
    half = BATCH // 2
    total = max(STEPS, EPOCHS * -(-max(map(len, by_label)) // half))
    order = [np.concatenate([rng.permutation(w) for _ in range(-(-total * half // len(w)))]) for w in by_label]
    for step in range(total * turn // ROUNDS, total * (turn + 1) // ROUNDS):
        pick = np.concatenate([w[step * half : (step + 1) * half] for w in order])
        network.step(*texts.take(pick), y[pick], RATE / (1 + 4 * step / total))


def _round(held, turn: int):
    """mapInArrow over rows sorted by shard: blocks of what the task's shards change of the network, of its sums of
    squared gradients, and of how many shards moved each parameter."""

    def run(batches):
        values, seen = held.value
        total = np.zeros((3, len(values)), np.float32)

        def train(shard: int, ids: list[bytes], y: list[int]) -> None:
            network = Network.of(values, seen)
            _learn(network, Texts.unpacked(ids), np.array(y, np.float32), shard, turn)
            new, squares = network.vectors()
            for own, more in zip(total, (new - values, squares - seen, squares != seen), strict=True):
                own += more

        of, ids, y, size = None, [], [], 0
        for batch in tables.slices(batches, "ids"):
            for shard, label, own in zip(*(batch.column(c).to_pylist() for c in ("shard", "y", "ids")), strict=True):
                if ids and (shard != of or size > 2 * SHARD_BYTES):
                    train(of, ids, y)
                    ids, y, size = [], [], 0
                of, size = shard, size + len(own)
                ids.append(own)
                y.append(label)
        if ids:
            train(of, ids, y)
            at = range(0, len(values), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in at], pa.int32()), pa.array([total[:, i : i + BLOCK].tobytes() for i in at], pa.binary())], names=["block", "change"])

    return run


def _summed(batches):
    """In one task of many: the sum of each block's rows, double inside."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, change in zip(batch.column("block").to_pylist(), batch.column("change"), strict=True):
            own = np.frombuffer(change.as_buffer(), np.float32).astype(float)
            sums[block] = sums[block] + own if block in sums else own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "change"])


def trained(rows: DataFrame) -> Network:
    """The network of all rows of ``shard``, ``y`` and ``ids``, which are sorted by shard."""
    spark = rows.sparkSession
    values, seen = Network().vectors()
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((values, seen))
        parts = rows.mapInArrow(_round(held, turn), "block int, change binary").repartition(32, "block")
        found = parts.mapInArrow(_summed, "block int, change binary").toArrow().sort_by("block")
        held.destroy()
        if not len(found):
            break
        change, squares, moved = np.concatenate([np.frombuffer(x, float).reshape(3, -1) for x in found.column("change").to_pylist()], axis=1)
        values = (values + change / np.maximum(moved, 1)).astype(np.float32)
        seen = (seen + squares / np.maximum(moved, 1)).astype(np.float32)
    return Network.of(values, seen)


def thresholds(rows: DataFrame, network: Network) -> dict[str | None, float]:
    """Thresholds of all ``rows`` (y, lang, ids), by exact counts of the scores in cells."""
    held = rows.sparkSession.sparkContext.broadcast(network)

    def work(batches):
        own = held.value
        for batch in tables.slices(batches, "ids"):
            texts = Texts.unpacked(batch.column("ids").to_pylist())
            p = own.score(texts.ids, texts.bounds[:-1])
            cell = np.floor(CELLS * np.clip(np.log(np.maximum(p, 1e-30) / np.maximum(1 - p, 1e-30)), -32, 32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y").cast(pa.int32()), pa.array(cell), pa.array(p)], names=["lang", "y", "cell", "p"])

    cells = rows.mapInArrow(work, "lang string, y int, cell int, p double").groupBy("lang", "cell")
    found = cells.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")).collect()
    held.destroy()

    def cut(names, enough):
        by_cell: dict[int, list[float]] = {}
        for r in found:
            if r.lang in names:
                low, high, n0, n1 = by_cell.get(r.cell, (1.0, 0.0, 0, 0))
                by_cell[r.cell] = [min(low, r.low), max(high, r.high), n0 + r.n0, n1 + r.n1]
        columns = np.array([by_cell[c] for c in sorted(by_cell)], float).reshape(-1, 4).T
        return _cut(*columns) if min(columns[2].sum(), columns[3].sum()) >= enough else None

    names = {r.lang for r in found}
    out = {name: cut({name}, ENOUGH) for name in names - {None}}
    return {None: 0.5 if (of_all := cut(names, 1)) is None else of_all} | {k: v for k, v in out.items() if v is not None}


def _common_key(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``key`` in the type that holds the keys of either, so that equal keys have equal hashes."""
    kind = docs.select("key").union(labels.select("key")).schema["key"].dataType
    return docs.withColumn("key", F.col("key").cast(kind)), labels.withColumn("key", F.col("key").cast(kind))


def fit(docs: DataFrame, labels: DataFrame, languages: langid.Model | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """``docs`` and ``labels`` hold only rows to learn from; all of them are learned from."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).where("key is not null")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label_col).alias("y"))
    rows, known = _common_key(rows, known)
    known = tables.scratch(known.groupBy("key").agg(F.max("y").alias("y")), "toxic-labels")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model(None, float(max(total, default=0)), languages, {None: 0.5})
    # Texts of rows without a label would be most of a join; a filter passes them over where they lie, at every size.
    rows = urlfilter.passing(rows, known, sum(total.values()), "key")
    rows = rows.withColumn("test", F.pmod(F.xxhash64(F.lit(SEED), F.col("key").cast("string")), F.lit(4)) == 0)
    held = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        own = held.value

        def work(batch):
            body, test = batch.column("body"), batch.column("test").to_numpy(zero_copy_only=False)
            lang = np.full(batch.num_rows, None, object)
            if own and test.any():
                lang[test] = own.names(body.filter(batch.column("test")))[0].to_pylist()
            ids = Texts.of(body).packed()
            return {"key": batch.column("key"), "test": batch.column("test"), "lang": pa.array(lang, pa.string()), "size": pa.array(map(len, ids), pa.int64()), "ids": pa.array(ids, pa.binary())}

        return work

    kind = rows.schema["key"].dataType.simpleString()
    ids = tables.scratch(tables.map_text(rows.select("key", "test", "body"), f"key {kind}, test boolean, lang string, size long, ids binary", make, "body"), "toxic")
    held.destroy()
    # Keys alone, and not broadcast where they happen to be few: what the filter let through without a label has none here.
    found = ids.select("key", "test", "size").join(known.hint("merge"), "key").groupBy("test", "y").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    sizes = {r.y: r.size for r in found if not r.test}
    if len(sizes) < 2:
        n = sum(r.n for r in found)
        return Model(None, sum(r.n * r.y for r in found) / n if n else 0.0, languages, {None: 0.5})
    shards = max(1, -(-sum(sizes.values()) // shard_bytes))
    # Bucket numbers meet their label on the way to their shard, the one time that they are moved.
    both = ids.select("key", "test", "lang", F.lit(None).cast("int").alias("y"), "ids").unionByName(known.select("key", F.col("y").cast("int").alias("y")), allowMissingColumns=True)
    both = both.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).repartition(min(shards, 1 << 12), "shard").sortWithinPartitions("shard", "key", "ids")
    dealt = both.withColumn("y", F.max("y").over(Window.partitionBy("shard", "key"))).where("ids is not null and y is not null")
    dealt = tables.scratch(dealt, "toxic-shards")
    network = trained(dealt.where("not test").select("shard", "y", "ids"))
    return Model(network, 0.0, languages, thresholds(dealt.where("test").select("y", "lang", "ids"), network))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row in a struct ``row``, with ``score`` (0 to 1; toxic from 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value
        return lambda batch: {"row": batch.column("row"), "score": pa.array(own.score(batch.column("body")), pa.float64())}

    packed = docs.select(F.struct(*(f"`{c}`" for c in keep)).alias("row"), F.col(text_col).alias("body"))
    return tables.map_text(packed, f"row {packed.schema['row'].dataType.simpleString()}, score double", make, "body")
