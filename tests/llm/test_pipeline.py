import random
import re
import zlib

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_neardup import brute as near

from scoretables.llm import tables

D = "/root/testdata/sf0.001"


def test_stages_each_on_its_own_input(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = tables.scratch(stage(spark, docs, D), name)
        assert docs.columns == before.columns and docs.schema == before.schema
        rows, left = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        assert all(left[i] == rows[i] for i in left) and len(left) == docs.count()
        gone = set(rows) - set(left)
        kept.append(len(left))
        if name == "near_duplicates":
            found = near([(i, r.text) for i, r in rows.items()], 5)
            assert gone == {i for i in found if not found[i][2]} and gone
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            assert gone == {r[0] for r in contaminated([(i, r.text) for i, r in rows.items()], items) if r[-1]} and gone
        elif name == "language":
            assert all(not re.search(r"[a-zA-Z]{3}", rows[i].text or "") or len(rows[i].text) < 40 for i in gone)
        else:
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
            assert sum(toxic.get(i) == 1 for i in gone) >= 0.8 * sum(x == 1 for x in toxic.values())
    pieces = P.STAGES[-1][1](spark, docs, D).collect()
    assert {p.doc_id for p in pieces} == set(left)
    for i in left:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True))


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en", "s", 1) for i in range(30)]
    rows += [(100, None, "en", None, 0), (101, "", None, "s", 0), (102, "... 12", "en", "s", 5), (103, "alpha " * 50_000, "en", "s", 1), (None, "alpha beta", "en", "s", 1), (5, rows[5][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "score": F.lit("x"), "sig": F.lit(2)})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.where("false")):
        left = start
        for name, stage in P.STAGES[:-1]:
            left = tables.scratch(stage(spark, left, str(tmp_path)), name)
            assert left.columns == docs.columns
        n = P.STAGES[-1][1](spark, left, str(tmp_path)).select("doc_id").distinct().count()
        assert n == left.select("doc_id").distinct().count() and (n > 20 or start is not docs)
        assert left.where("doc_id in (100, 101, 102)").count() == 0
