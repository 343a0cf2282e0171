import hashlib
import random
import re

from pyspark.sql import functions as F

from scoretables.llm import decontaminate as D

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, n=13):
    windows = {}
    for i, t in items:
        w = PATTERN.findall((t or "").translate(LOWER))
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = PATTERN.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "naïve"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(12)]
    items += [(3, items[3][1]), (20, None), (21, "..."), (None, "w1 w2 w3"), (10, items[0][1])]
    docs = [(0, None), (1, ""), (2, "?!"), (3, " ".join(rng.choices(vocabulary, k=3000)))]
    for i in range(4, 40):
        item = (rng.choice(items)[1] or "").upper()
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 200]))) + ", " + item + "- " + " ".join(rng.choices(vocabulary, k=rng.choice([0, 7])))))
    return docs + [docs[9], (None, docs[8][1])], items


def test_against_brute_force_also_in_blocks_of_the_benchmark(spark):
    docs, items = cases()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 200):
        found = D.judged(D.hits(left, right, index_bytes=size)).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, brute(docs, items)))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.judged(D.hits(docs, items)).select("n_hit", "contaminated").collect() == [(0, False)]
    assert D.hits(docs.where("false"), items).count() == 0


def test_spans_and_documents_keep_clashing_columns(spark):
    item = " ".join(f"t{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after"), (2, "clean text"), (3, None)], "doc_id long, text string").withColumns({"n_hit": F.lit("x"), "row": F.lit(7), "hits": F.lit(1), "key": F.lit("k"), "body": F.lit("b")})
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    cut = D.without_spans(docs, items)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Before, ! after", 2: "clean text", 3: None}
    left = D.without_documents(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
