import random
import re

from pyspark.sql import functions as F

from scoretables.llm import neardup as N
from scoretables.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, width, threshold=80):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and (x := find(a)) != (y := find(b)):  # a link within a component adds nothing
                common = len(sets[a] & sets[b])
                if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def cases():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [None, "", " \t ", "one", "ONE", "one two", "One  two\n"]
    for size in (6, 30, 120):
        base = rng.choices(vocabulary, k=size)
        docs += [" ".join(base)] * 3
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, size // 8)):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    docs.append(" ".join(rng.choices(vocabulary, k=20_000)))
    return [(i * 3 % 997, t) for i, t in enumerate(docs)]


def test_against_brute_force(spark):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for width in (2, 5):
        found = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, width=width).collect()}
        assert found == brute(docs, width)


def test_full_regions_are_complete(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 128)
    monkeypatch.setattr(N, "OWN", 64)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    docs = []
    for i in range(600):
        own = set(rng.sample(range(100), rng.randint(5, 22)))
        docs.append((i, " ".join(f"d{i}x{k}" if k in own else w for k, w in enumerate(base))))
    found = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=1).collect()}
    assert found == brute(docs, 1)


def test_kept_documents_keep_columns_and_odd_rows(spark):
    docs = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "a b c d e f g"), (None, "zz yy"), (6, "zz yy xx"), (6, "zz yy xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"sig": F.lit(1), "rep": F.lit("r"), "id": F.lit(0), "root": F.lit(2)})
    kept = N.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 6, 6]
    assert N.near_duplicates(df).where("id is null").select("component_id").collect() == [(None,)]
    assert N.near_duplicates(df.where("false")).count() == 0


def test_crowded_groups_against_brute_force(spark):
    rng = random.Random(7)
    docs, start = [], 0
    for n, size, most in ((450, 100, 8), (250, 60, 5)):
        base = [f"g{size}w{k}" for k in range(size)]
        for i in range(n):
            own = set(rng.sample(range(size), rng.randint(1, most)))
            docs.append((start + i, " ".join(f"d{start + i}x{k}" if k in own else w for k, w in enumerate(base))))
        start += n
    found = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=2).collect()}
    assert found == brute(docs, 2)


def test_registered_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_lsh_forest(spark, sf).collect()} == brute(docs, 2)
