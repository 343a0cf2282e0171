import hashlib

import pytest
from pyspark.sql import functions as F

from scoretables.llm import linededup as L
from scoretables.llm import queries

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(L._UPPER, L._LOWER)


def brute(rows, least_chars=40, least_documents=5):
    """(id, lines, dropped, what stays) of each row, by loops."""
    holders = {}
    for i, body in rows:
        for line in (body or "").split("\n") if i is not None else ():
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= least_chars:
                holders.setdefault(key, set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= least_documents}
    out = []
    for i, body in rows:
        lines = (body or "").split("\n")
        kept = [x for x in lines if i is None or last.get(x.strip(BLANKS).translate(LOWER), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("doc", "body", "keep", "version", "hash", "n_dropped", "row")})
    found = L.dedup(df, **options).select("row.doc_id", "n_lines", "n_dropped", L.kept_text(F.col("row.text"), F.col("keep")).alias("kept"), "keep")
    rows = found.collect()
    for r in rows:  # only words with lines that go, in order, and as many bits
        assert [w.word for w in r.keep] == sorted({w.word for w in r.keep}) and all(w.keep != -1 for w in r.keep)
        assert sum((~w.keep & (1 << 64) - 1).bit_count() for w in r.keep) == r.n_dropped
    return sorted(tuple(r)[:4] for r in rows if r.doc_id is not None) + [tuple(r)[:4] for r in rows if r.doc_id is None]


def expected(rows, **options):
    out = brute(rows, **options)
    return sorted(r for r in out if r[0] is not None) + [r for r in out if r[0] is None]


SHARED = "This line is shared by a good many documents"
WIDE = "é½" * 20  # 40 code points, 80 bytes


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"own {i}\n{SHARED}\n  {SHARED.upper()}\t\nshort\nshort") for i in range(8)]
    out += [(20 + i, f"{WIDE}\n{'x' * 39}\n{'y' * 40} {i % 2}") for i in range(6)]
    out += [(30 + i, "É" + "a" * 45 if i % 2 else "é" + "a" * 45) for i in range(8)]  # not A-Z: two keys, four documents each
    out += [(40, None), (41, ""), (42, "\n\n"), (43, " " + SHARED), (44, f"{SHARED}\r\n\r\n{SHARED}")]
    out += [(45, "\n".join(f"{SHARED}" if k % 100 == 7 else f"line {k}" for k in range(20_000))), (46, SHARED * 5_000)]
    out += [(3, out[3][1]), (3, out[3][1]), (5, f"{SHARED}\nanother text of the same id"), (None, f"{SHARED}\nno id"), (None, None)]
    return out


def test_against_loops(spark, rows):
    assert found_of(spark, rows) == expected(rows)


def test_other_bounds(spark, rows):
    assert found_of(spark, rows, least_chars=5, least_documents=2) == expected(rows, least_chars=5, least_documents=2)
    assert found_of(spark, rows, least_chars=0, least_documents=1) == expected(rows, least_chars=0, least_documents=1)


def test_a_repeated_row_is_one_document(spark):
    rows = [(1, SHARED)] * 6 + [(2, SHARED), (3, SHARED), (4, SHARED)]
    assert found_of(spark, rows) == expected(rows) and all(r[2] == 0 for r in expected(rows))


def test_no_documents(spark):
    assert found_of(spark, []) == []


def test_registered_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
    found = queries.op13_line_bitmaps(spark, sf)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want


def test_plan_is_native(spark, sf):
    found = queries.op13_line_bitmaps(spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions"))


def test_ranges_need_no_second_exchange(spark):
    lines = spark.createDataFrame([(bytes([i]), i, 0) for i in range(20)], "hash binary, doc long, pos int")
    ordered = lines.repartitionByRange(F.col("hash"), F.col("doc"))
    from pyspark.sql import Window

    plan = ordered.withColumn("k", F.row_number().over(Window.partitionBy("hash", "doc").orderBy("pos")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
