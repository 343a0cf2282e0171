"""Ordered passes over many small documents: no call for each document, and states that live on from batch to batch."""

import pytest

from scoretables import catalogue
from scoretables.operators import passes

NAMES = ("spine_columns", "cue_passages", "note_columns", "lagging_rests", "rescaled_regions")


@pytest.mark.parametrize("name", NAMES)
def test_no_call_for_each_document(spark, sf, name):
    found = catalogue.QUERIES[name](spark, sf)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    whole = sorted(map(repr, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(repr, catalogue.QUERIES[name](spark, sf).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_of_null_and_other_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 2, "d"), ("x", 1, "c"), ("y", 1, "e")], "doc_id string, line_no long, t string")
    found = passes.grouped(df, ["doc_id"], ["line_no"], {"n": "long", "all": "array<string>"}, lambda rows: [(len(rows), [t for _, t in rows])])
    assert {(r.doc_id, r.n, tuple(r["all"])) for r in found.collect()} == {(None, 2, ("a", "b")), ("x", 2, ("c", "d")), ("y", 1, ("e",))}
    assert passes.grouped(df.where("t = 'z'"), ["doc_id"], ["line_no"], {"n": "long"}, lambda rows: [(len(rows),)]).count() == 0


def test_tokens_of_lines_are_not_moved_one_by_one(spark, sf):
    from scoretables.operators import tokens
    from scoretables.sources import standins

    def plan(name):
        return catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    for name in ("shortest_per_line", "rhythm_targets", "compact_targets"):
        # Only documents are taken apart before the shuffle, into lines.
        assert "split(line" not in "".join(x for x in plan(name).splitlines() if "Generate" in x), name
    assert plan("token_frequencies").count("Exchange hashpartitioning(doc_id") == 1 and plan("token_frequencies").count("Exchange ") == 1
    assert plan("token_sequences").count("Exchange ") == 1

    lines, exploded = standins.view(spark, sf, "lines"), standins.view(spark, sf, "tokens")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tokens.shortest_of_lines(standins.parts(lines))) == rows(tokens.shortest(exploded))
    assert rows(standins.tokens_by_document(lines)) == rows(exploded)


def test_ratios_are_planned_quickly(spark, sf):
    """The expression of all cases had the planner at work for half a minute, on any table."""
    import time

    began = time.time()
    catalogue.QUERIES["ratio_tokens"](spark, sf)._jdf.queryExecution().executedPlan()
    assert time.time() - began < 15


def test_score_sequences_take_fields_apart_outside_of_expressions(spark, sf):
    """Nested expressions took the factors of a note several times over, and tokens were put in order one by one."""
    from pyspark.sql import functions as F

    from scoretables.operators import tokens

    plan = catalogue.QUERIES["score_sequences"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "([A-G])" not in plan and plan.count("Generate posexplode") == 1 and plan.count("Exchange ") == 1
    text = [(1, 1, "**a\t**b"), (1, 2, "4c# 4e\t[8.G\t"), (1, 3, "!x"), (1, 4, "x\t4c\tx"), (1, 5, "x"), (1, 6, ""), (1, 7, "=1"), (1, 8, None), (1, 9, "*^\t*"), (2, 1, "x"), (None, 1, "2r"), (3, 1, "*a")]
    lines = spark.createDataFrame(text, "doc_id long, line_no long, line string")
    whole = tokens.score_sequence(lines).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("all"))
    want = {r.doc_id: (len(r["all"]), " ".join(r["all"])) for r in whole.collect()}
    assert {r.doc_id: (r.n_tokens, r.body) for r in tokens.score_bodies(lines).collect()} == want
    assert want[1][1] == "<sos> 4 c# 4 e <coc> [ 8. G <nl> <coc> 4 c <coc> <nl> <bar> <split> <coc> <*> <eos>" and want[2] == (2, "<sos> <eos>") and set(want) == {None, 1, 2}


def test_factors_of_strings_equal_the_expressions(spark):
    import random

    from scoretables.functions import tokens as T

    rng = random.Random(3)
    made = ["", ".", "4c\r", "8cLL\r", "4cL ", "[4c]\x85", "qq", "16", "[4", "4r]", "é4c", "4c#-n", "4c-#"]
    made += ["".join(rng.choices("0124.[](){}_qQPrabcgCDG##--nLJkK ~/é\r", k=rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in made], "t string")
    for r in df.select("t", T.factors(df.t).alias("f"), T.split_notes(df.t).alias("s")).collect():
        assert (T._factors(r.t), T._split_notes(r.t)) == (r.f, r.s), r.t


def test_groups_go_through_tokens_once_and_move_lines_only(spark, sf):
    """Distinct problems were looked for in a second run over all tokens, which were moved by spine."""
    plan = catalogue.QUERIES["group_tokens"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan


def test_ratios_go_through_lines_once_and_move_no_token(spark, sf):
    """Words were moved one by one, twice, and joined to the few problems that all of them share."""
    plan = catalogue.QUERIES["ratio_tokens"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("Exchange ") == plan.count("Exchange hashpartitioning(doc_id") == 1
    assert "Join" not in plan and "Window" not in plan and "split(line" not in "".join(x for x in plan.splitlines() if "Generate" in x)


def test_runs_of_ratios_go_on_from_slice_to_slice(spark):
    """Against loops, cut anywhere; with nulls, empty tokens, numbers that are no longs, uneven lines and long runs."""
    import random
    import re

    import pyarrow as pa

    from scoretables.operators import rhythms as Y

    rng = random.Random(5)
    words = ["8%3c", "[8%3c", "8%3r", "8%3.c 8%3e", "56%3c", "44%1c", "9%2r", "9%2c", "0%3c", "8%0c", "8%99999999999999999999c", "008%3c", "9%" + "1" * 5000, "4g", ".", "", None, "8%9{c", "({9%2e", "16%2c"]
    rows = []
    for doc in (None, 1, 2, 3, 4):
        for line_no in range(90 if doc == 4 else rng.choice([3, 40])):
            bar = rng.choice([None, *[False] * 20, True])
            rows.append((doc, line_no, bar, 0, rng.choices(words if doc != 4 else ["56%3c"] * 99 + words, k=rng.choice([0, 1, 3, 70_000 if (doc, line_no) == (2, 1) else 6]))))
    rows.append((5, 0, False, 0, None))
    types = [("doc_id", pa.int64()), ("line_no", pa.int64()), ("is_bar", pa.bool_()), ("first", pa.int64()), ("parts", pa.list_(pa.string()))]
    whole = pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], schema=pa.schema(types))

    runs, now = [], {}
    for doc, line_no, bar, _, parts in rows:
        for spine, token in enumerate(parts or ()):
            if not bar and token in (None, ".", ""):
                continue
            x, y = re.search("([0-9]+)%([0-9]{1,25})", token or "").groups() if bar is False and "%" in token else ("0", "0")
            ratio = (int(x), int(y)) if 0 < int(x) < 1 << 63 and 0 < int(y) < 1 << 63 else None
            if ratio is None:
                now.pop((doc, spine), None)
            else:
                if now.get((doc, spine), (None,))[0] != ratio:
                    now[doc, spine] = (ratio, [])
                    runs.append(now[doc, spine])
                now[doc, spine][1].append((doc, spine, line_no, token))
    want = []
    for ratio, run in runs:
        kind, names, pair = Y._solution(*ratio, len(run))
        for i, (*key, token) in enumerate(run):
            if pair:
                rest = re.sub(r"^[\[({]*[0-9]+%[0-9]+\.?", "", token)
                tied = ("", "") if rest.startswith("r") else ("[", "]")
                want += [(*key, 0, tied[0] + pair[0] + rest, kind), (*key, 1, pair[1] + rest + tied[1], kind)]
            else:
                want.append((*key, 0, re.sub(r"[0-9]+%[0-9]+\.?", names[i], token), kind))
    want.sort(key=repr)
    assert {k for *_, k in want} == {"dotted", "same", "mixed", "pair", "nearest"} and max(len(run) for _, run in runs) > 8
    for lines, tokens in ((whole.num_rows, 250_000), (whole.num_rows, 5), (7, 250_000), (1, 1)):
        pieces = (piece for i in range(0, whole.num_rows, lines) for piece in Y._slices(whole.slice(i, lines), tokens))
        found = [tuple(r.values()) for made in Y._without_ratios(pieces) for r in made.to_pylist()]
        assert sorted(found, key=repr) == want, (lines, tokens)

    kinds = "doc_id long, line_no long, spine long, token string, is_bar boolean"
    few = [(d, n, s, t, b) for d, n, b, _, parts in rows for s, t in enumerate(parts or ()) if s < 6]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = [tuple(r) for r in Y.without_ratios(spark.createDataFrame(few, kinds)).select("doc_id", "spine", "line_no", "sub", "token", "kind").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found, key=repr) == [r for r in want if r[1] < 6]
