"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams, the
longest order (of 5 down to 1, with word ends marked) of which any is known. Word scores are normalised over the
languages and added up over the whole text. Words are runs of letters, lower-cased; in the tables words and n-grams
stand as 64-bit hashes, in sorted arrays, and a slice of texts is looked up at once.

The tables hold every word and n-gram of the sample learned from. The sample is a bound on labelled rows: about FIT
rows and FIT_BYTES of text at most, shared out evenly over the languages, so that a small language gives all its rows.
The model has one row of float32 for each word and n-gram of the sample, and is all that is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learned. Documents without a language teach nothing. Of equally likely languages the first by name is taken. Repeated
rows are judged, and learned from, each. A text of any length is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretables.llm import tables, text

FIT, FIT_BYTES = 20_000, 64 << 20
ORDERS = (5, 4, 3, 2, 1)
#: A text's evidence counts as that of so many words at most, which keeps scores away from exactly 1.
EVIDENCE = 40
UND = "und"
_NOT_BLANK = ~text.byte_class((0x20, 0x20))


def letters(column: pa.Array) -> text.Words:
    """The words of each text: runs of letters, lower-cased."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column), r"\P{L}+", " ")
    return text.Words(plain, _NOT_BLANK, lower=False)


class Grams:
    """Character n-grams of ``<word>`` for some words, given by their places in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size + 2)])
        marked = np.empty(at[-1], np.uint8)
        marked[at[:-1]], marked[at[1:] - 1] = ord("<"), ord(">")
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(at[:-1] + 1, size) + step] = data[np.repeat(starts, size) + step]
        chars = np.flatnonzero((marked & 0xC0) != 0x80)
        self.bounds = np.searchsorted(chars, at)
        self.edges = np.append(chars, len(marked))
        self.sums = text.prefix_sums(marked)

    def of(self, order: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of ``words`` (indexes), and the word of each."""
        n = np.maximum(np.diff(self.bounds)[words] - order + 1, 0)
        first = np.repeat(self.bounds[words], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return text.span_hashes(self.sums, self.edges[first], self.edges[first + order]), np.repeat(words, n)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among sorted ``keys``, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Log frequencies by language, for sorted hashes of words and of n-grams."""

    def __init__(self, languages: list[str], words: np.ndarray, word_table: np.ndarray, grams: np.ndarray, gram_table: np.ndarray):
        self.languages, self.words, self.grams = languages, words, grams
        self.word_table, self.gram_table = word_table, gram_table

    def _scores(self, found: text.Words, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A row of scores for each distinct word, whose hashes are ``own`` and which stand at the words ``first``."""
        at, known = _found(self.words, own)
        out = np.zeros((len(own), len(self.languages)))
        out[known] = self.word_table[at[known]]
        left = np.flatnonzero(~known)
        grams = Grams(found.data, found.starts[first[left]], found.ends[first[left]])
        waiting = np.arange(len(left))
        for order in ORDERS:
            keys, word = grams.of(order, waiting)
            at, known = _found(self.grams, keys)
            at, word = at[known], word[known]
            if len(word):
                begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                n = np.diff(np.append(begins, len(word)))
                out[left[word[begins]]] = np.add.reduceat(self.gram_table[at], begins, axis=0, dtype=float) / n[:, None]
                waiting = np.setdiff1d(waiting, word[begins], assume_unique=True)
            if not len(waiting):
                break
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the place of its language in ``languages`` (-1: ``und``) and its score."""
        best, score = np.full(len(column), -1), np.zeros(len(column))
        found = letters(column)
        n = np.diff(found.bounds)
        rows = np.flatnonzero(n)
        if self.languages and len(rows):
            own, first, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
            total = np.add.reduceat(self._scores(found, first, own)[inverse], found.bounds[:-1][rows], axis=0)
            total *= np.minimum(1.0, EVIDENCE / n[rows])[:, None]
            best[rows] = total.argmax(axis=1)
            score[rows] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return best, score

    def names(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        best, score = self.predict(column)
        return pa.array([*self.languages, UND], pa.string()).take(pa.array(np.where(best < 0, len(self.languages), best))), score


def _normalised(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log frequency by language, less its mean in the log domain over the languages."""
    out = np.log((counts + 0.5) / (size + 0.5 * (len(counts) + 1)))
    top = out.max(axis=1, keepdims=True) if len(out) else out
    return (out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))).astype(np.float32)


def _table(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts by language, of rows ``key``, ``lang``, ``n``."""
    got = rows.select("key", "lang", "n").toArrow()
    keys, at = np.unique(got.column("key").to_numpy().view(np.uint64), return_inverse=True)
    counts = np.zeros((len(keys), len(languages)), np.float32)
    lang = pc.index_in(got.column("lang"), pa.array(languages, pa.string())).to_numpy()
    counts[at, lang] = got.column("n").to_numpy()
    return keys, counts


def _sample(known: DataFrame, bound: int, most_bytes: int) -> tuple[DataFrame, list[str]]:
    """Of each language all rows, or so many by a hash of id and text that every language keeps to its share of the bounds."""
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes")).collect()
    take = F.lit(False)
    for r in sizes:
        part = min(1.0, bound / len(sizes) / r.n, most_bytes / len(sizes) / max(r.bytes, 1))
        take = F.when(F.col("lang") == r.lang, F.pmod(F.xxhash64("id", "body"), F.lit(1 << 30)) < int(part * (1 << 30))).otherwise(take)
    return known.where(take), sorted(r.lang for r in sizes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = FIT, most_bytes: int = FIT_BYTES) -> Model:
    """``docs`` holds only rows to learn from."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body")).where("lang is not null and body is not null")
    rows, languages = _sample(known, bound, most_bytes)

    def words_of():
        def work(batch):
            lang, item, key, n = [], [], [], []
            for name in pc.unique(batch.column("lang")).to_pylist():
                found = letters(batch.column("body").filter(pc.equal(batch.column("lang"), name)))
                own, first, counts = np.unique(found.hashes(), return_index=True, return_counts=True)
                lang += [name] * len(own)
                item += [found.word(i).decode() for i in first.tolist()]
                key.append(own)
                n.append(counts)
            keys, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, n))
            return {"lang": pa.array(lang, pa.string()), "item": pa.array(item, pa.string()), "key": pa.array(keys.view(np.int64)), "n": pa.array(counts, pa.int64())}

        return work

    def grams_of():
        def work(batch):
            items = text.Words(batch.column("item"), np.ones(256, bool), lower=False)
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            grams, out = Grams(items.data, items.starts, items.ends), []
            for order in ORDERS:
                keys, word = grams.of(order, np.arange(len(items.starts)))
                for k in range(len(names)):
                    own, counts = np.unique(keys[code[word] == k], return_counts=True)
                    out.append((np.full(len(own), k), np.full(len(own), order), own.view(np.int64), counts))
            lang, order, key, n = (np.concatenate(x) for x in zip(*out, strict=True))
            return {"lang": pa.array(names.tolist(), pa.string()).take(pa.array(lang)), "order": pa.array(order, pa.int32()), "key": pa.array(key), "n": pa.array(n, pa.int64())}

        return work

    words = tables.map_text(rows.select("lang", "body"), "lang string, item string, key long, n long", words_of, "body")
    words = tables.scratch(words.groupBy("lang", "key").agg(F.min("item").alias("item"), F.sum("n").alias("n")), "words")
    # Unseen words resemble rare ones, so every distinct word counts once.
    grams = tables.map_text(words.select("lang", "item"), "lang string, order int, key long, n long", grams_of, "item")
    grams = tables.scratch(grams.groupBy("lang", "order", "key").agg(F.sum("n").alias("n")), "grams")
    size = {r.lang: float(r.n) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = [x for x in languages if x in size]
    word_keys, counts = _table(words, languages)
    word_table = _normalised(counts, np.array([size[x] for x in languages]))
    parts = []
    for order in ORDERS:
        keys, counts = _table(grams.where(F.col("order") == order), languages)
        parts.append((keys, _normalised(counts, counts.sum(axis=0, dtype=float))))
    keys, table = (np.concatenate(x) for x in zip(*parts, strict=True))
    by_key = np.argsort(keys, kind="stable")
    return Model(languages, word_keys, word_table, keys[by_key], table[by_key])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row in a struct ``row``, with ``lang_pred`` and ``score`` (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def work(batch):
            names, score = own.names(batch.column("body"))
            return {"row": batch.column("row"), "lang_pred": names, "score": pa.array(score)}

        return work

    packed = docs.select(F.struct(*(f"`{c}`" for c in keep)).alias("row"), F.col(text_col).alias("body"))
    return tables.map_text(packed, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double", make, "body")
