"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of packets: its documents, in table order, cut every ``length`` tokens. A round gives every
source its quantum (its target share of a window of WINDOW sequences, in whole tokens) on top of what it has left over;
it sends the packets that this covers and carries the deficit on. So a packet that ends at token c of its queue goes
out in round ceil(c / quantum), whichever partition it is in, and a source's share of any run of windows is off its
target by less than one packet. The rounds, one after the other, are cut into sequences of ``length`` tokens.

Queues are never gathered: starts come from sums of blocks of rows, added up block by block on two levels. All
sequences are full; the tokens left at the end fill sequences of falling powers of two, which need no padding.

Targets are given by source, or follow from a ``temperature`` t, as the sources' shares of all tokens to the power t:
below 1 small sources are sent sooner than their size asks for. A queue that runs dry sends nothing more; from then on
the others share the windows in the ratio of their targets.

Defined results: a null text is empty and has the end token only; null sources form a queue of their own; repeated rows
are packed each; a source without a target in ``targets`` gets the share that it has of all tokens; one with a target of
zero or less takes no part in the mixture and is packed after all others. Text that spells an added token of the
tokenizer file is that token, as the tokenizers library has it. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import itertools
import json
import pathlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoretables.llm import tables

LENGTH = 2048
#: Sequences of a window, the run over which the mixture is kept.
WINDOW = 64
# Fixed value: the pattern by which byte-level BPE tokenizers of this family split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a block, blocks of a block of blocks, and rounds of a block, whose sums are added up together.
BLOCK_BITS, FAR_BITS, ROUNDS = 10, 10, 4096
#: Letters of a part of a text that is held in memory, at most.
LONGEST = 64
#: White space other than the blank, as any of the libraries understands it.
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_FORMATS = [struct.Struct(f"<{n}I") for n in range(32)]


def single_blanks(body: str) -> bool:
    """Whether every blank stands between two characters that are not white space, and no wide space occurs."""
    if body[0] == " " or body[-1] == " " or "  " in body:
        return False
    for c in _SPACES:
        if c in body and (c + " " in body or " " + c in body):
            return False
    return body.isascii() or not any(c in body for c in _WIDE_SPACES)


def _byte_letters() -> dict[str, int]:
    """The printable character that byte-level BPE files write for each byte, back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_encoding(path: str):
    """A tiktoken encoding with the ids of the tokenizer file, or None where the file's rules differ.

    They agree if the file is a byte-level BPE without a leading blank, with the usual pattern, whose merges make the
    ids in rising order, because then the order of merges is the order of ids.
    """
    import tiktoken

    kind = json.loads(pathlib.Path(path).read_text(encoding="utf-8"))
    model, split = kind["model"], kind.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and kind.get("normalizer") is None
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 + len({t["content"] for t in kind.get("added_tokens", ())} & set(vocab)) < len(vocab):
        return None
    extra = {t["content"] for t in kind.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in extra}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file, with a memory of the parts between single blanks.

    The tokenizer splits a text before any blank that stands between two other characters, so such parts are encoded
    one by one, each with its blank, and found again the next time. A text with other white space around a blank is
    encoded whole. Parts of more than LONGEST letters are not held, and of ``most`` parts held the later half is
    forgotten, so the memory takes at most some 150 MB. Texts that hold an added token, and files whose
    rules fast_encoding() does not cover, are left to the tokenizers library.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.fast, self.most, self.path = fast_encoding(path), most, path
        self.known: dict[str, bytes] = {}
        self.added = [t["content"] for t in json.loads(pathlib.Path(path).read_text(encoding="utf-8")).get("added_tokens") or ()]

    @functools.cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def _whole(self, body: str) -> bytes:
        if self.fast is None or any(t in body for t in self.added):
            return np.array(self.library.encode(body, add_special_tokens=False).ids, "<u4").tobytes()
        return self._plain(body)

    def _plain(self, body: str) -> bytes:
        """Ids of a text without added tokens."""
        ids = self.fast.encode_ordinary(body)
        return _FORMATS[len(ids)].pack(*ids) if len(ids) < len(_FORMATS) else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, known = [], self.known
        for body in texts:
            if not body or self.fast is None or not single_blanks(body) or any(t in body for t in self.added):
                out.append(self._whole(body) if body else b"")
                continue
            first, *parts = body.split(" ")
            found = [known.get(x) for x in parts]
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        part = parts[i]
                        found[i] = ids = known.get(part) or self._plain(" " + part)
                        if len(part) <= LONGEST:
                            known[part] = ids
                if len(known) > self.most:
                    # Frequent parts were met first; the later half makes room.
                    known = self.known = dict(itertools.islice(known.items(), self.most // 2))
            out.append(self._whole(first) + b"".join(found))
        return out


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A written table of ``key`` (of the row), ``id``, ``source``, ``n_tokens`` and ``ids``, the end token included."""

    def make():
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()

        def work(batch):
            ids = [x + end for x in encoder.encode([x or "" for x in batch.column("body").to_pylist()])]
            return {"id": batch.column("id"), "source": batch.column("source"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("body"))
    rows = tables.map_text(rows, f"id {docs.schema[id_col].dataType.simpleString()}, source string, n_tokens long, ids binary", make, "body")
    return tables.scratch(rows.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("key", F.monotonically_increasing_id()), "tokens")


def _before(*keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _running(df: DataFrame, group: str, key: str, size: str, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over the rows of the group with a smaller ``key``, by sums of blocks of neighbouring rows.

    A task adds up the rows of a block, the blocks of a block of blocks, or these: none of them holds a whole group.
    """
    df = df.withColumn("block", F.shiftright(key, BLOCK_BITS))
    near = tables.scratch(df.groupBy(group, "block").agg(F.sum(size).alias("n")).withColumn("far", F.shiftright("block", FAR_BITS)), "blocks")
    sum_before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    far = near.groupBy(group, "far").agg(F.sum("n").alias("n")).select(group, "far", sum_before(_before(group, order="far")).alias("far_start"))
    near = near.withColumn("block_start", sum_before(_before(group, "far", order="block"))).join(far, [group, "far"])
    starts = near.select(group, "block", (F.col("far_start") + F.col("block_start")).alias("block_start"))
    inside = F.coalesce(F.sum(size).over(_before(group, "block", order=key)), F.lit(0))
    return df.join(tables.scratch(starts, "starts"), [group, "block"]).withColumn(out, F.col("block_start") + inside).drop("block", "block_start")


def quanta(totals: DataFrame, total: int, targets: dict[str, float] | None, temperature: float, length: int, window: int) -> DataFrame:
    """``source``, its ``quantum`` of tokens for a round, and ``late``: the rounds that go before its first one."""
    weight = F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(temperature))
    whole = totals.agg(F.coalesce(F.sum(weight), F.lit(1.0)).alias("n")).first().n
    share = weight / F.lit(whole)
    if targets:
        known = totals.sparkSession.createDataFrame(list(targets.items()), "source string, target double")
        totals, share = totals.join(known, "source", "left"), F.coalesce("target", share)
    positive = F.greatest(F.lit(1), F.round(share * length * window)).cast("long")
    out = totals.select("source", "tokens", (share > 0).alias("mixed"), F.when(share > 0, positive).otherwise(F.lit(length * window)).cast("long").alias("quantum"))
    late = out.where("mixed").agg(F.max(F.expr("(tokens + quantum - 1) div quantum")).alias("n")).first().n or 0
    return tables.scratch(out.select("source", "quantum", F.when(F.col("mixed"), F.lit(0)).otherwise(F.lit(late)).cast("long").alias("late")), "quanta")


def layout(lengths: DataFrame, targets: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, temperature: float = 1.0) -> DataFrame:
    """Pieces of the rows of ``lengths`` (key, source, n_tokens): ``key``, ``start``, ``length``, ``sequence_id``, ``offset``."""
    totals = tables.scratch(lengths.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    rows = _running(lengths, "source", "key", "n_tokens", "before")
    # A source's quantum comes with the row. As a written table its size is known, and it is broadcast only if it is small.
    rows = rows.join(quanta(totals, total, targets, temperature, length, window), "source")
    sent = f"(before + least({length} * (k + 1), n_tokens) + quantum - 1) div quantum"
    rows = rows.withColumn("last", F.expr(f"(n_tokens - 1) div {length}"))
    # The first packet of each round, of which the packets up to the next one make one piece.
    firsts = F.expr(f"filter(sequence(0L, last), k -> k = 0 or {sent} <> {sent.replace('(k + 1)', 'k')})")
    runs = rows.withColumn("firsts", firsts).select("*", F.posexplode("firsts").alias("i", "k"))
    runs = runs.withColumn("round", F.col("late") + F.expr(sent)).withColumn("start", F.col("k") * length)
    stop = F.coalesce(F.try_element_at("firsts", F.col("i") + 2) * length, F.col("n_tokens"))
    runs = runs.withColumn("length", stop - F.col("start"))
    runs = tables.scratch(runs.select("key", "source", "round", "start", "length", (F.col("before") + F.col("start")).alias("at")), "runs")
    # Where each source's part of each round begins in the stream of all tokens.
    parts = runs.groupBy("round", "source").agg(F.sum("length").alias("tokens"), F.min("at").alias("from"))
    parts = tables.scratch(parts, "parts")
    parts = parts.withColumn("in_round", F.coalesce(F.sum("tokens").over(_before("round", order="source")), F.lit(0)))
    rounds = tables.scratch(runs.groupBy("round").agg(F.sum("length").alias("n")).withColumn("far", F.floor(F.col("round") / ROUNDS)), "rounds")
    sum_before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    # One row for each ROUNDS rounds, each of which is WINDOW sequences: a window over all of them stays small.
    far = rounds.groupBy("far").agg(F.sum("n").alias("n")).select("far", sum_before(_before(order="far")).alias("far_start"))
    rounds = rounds.withColumn("near", sum_before(_before("far", order="round"))).join(far, "far").withColumn("begin", F.col("far_start") + F.col("near"))
    parts = tables.scratch(parts.join(rounds.select("round", "begin"), "round").select("round", "source", (F.col("begin") + F.col("in_round") - F.col("from")).alias("shift")), "places")
    placed = runs.join(parts, ["round", "source"]).withColumn("pos", F.col("at") + F.col("shift"))
    cut = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(pos div {length}, (pos + length - 1) div {length})")))
    low, high = F.greatest("pos", F.col("sequence_id") * length), F.least(F.col("pos") + F.col("length"), (F.col("sequence_id") + 1) * length)
    cut = cut.select("key", (F.col("start") + low - F.col("pos")).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * length).alias("offset"))
    return _tail(cut, total, length)


def _tail(pieces: DataFrame, total: int, length: int) -> DataFrame:
    """Cut the last, unfilled sequence into sequences of falling powers of two."""
    rest, last = total % length, total // length
    edges = [0]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    if len(edges) <= 2:
        return pieces
    spans = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(last + i).cast("long").alias("s")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
    inside = F.filter(spans, lambda x: (x["a"] < F.col("offset") + F.col("length")) & (x["b"] > F.col("offset")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(length).cast("long").alias("b"), F.col("sequence_id").alias("s")))
    cut = pieces.withColumn("span", F.explode(F.when(F.col("sequence_id") < last, whole).otherwise(inside)))
    low, high = F.greatest("offset", "span.a"), F.least(F.col("offset") + F.col("length"), F.col("span.b"))
    return cut.select("key", (F.col("start") + low - F.col("offset")).alias("start"), (high - low).alias("length"), F.col("span.s").alias("sequence_id"), (low - F.col("span.a")).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, temperature: float = 1.0) -> DataFrame:
    """Per piece ``id``, ``source``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    tokens = tokenized(docs, tokenizer_path, end_id, id_col, text_col, source_col)
    pieces = layout(tokens.select("key", "source", "n_tokens"), targets, length, window, temperature)
    ids = F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return pieces.join(tokens, "key").select("id", "source", "start", "length", ids.alias("ids"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")
