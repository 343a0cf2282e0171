"""Examples and invariants of operators that SQL cannot express, and unit-size cases of the scalar functions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from scoretables import catalogue
from scoretables.functions import tokens as T
from scoretables.operators import bands, batching, chunking, examples, ids, notes, spines, summaries, tokens, transition
from scoretables.sources import files


def each(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    return {r.t: r.v for r in df.select("t", f(F.col("t")).alias("v")).collect()}


def check(spark, f, cases):
    assert each(spark, f, cases) == cases


def test_clean(spark):
    check(spark, T.clean, {"*clefG2yy": "*clefG2", "!LO:N:vis=5": "!", "!LO:N": "!LO:N", "*M4/4": "*M4/4"})
    check(spark, T.clean_line, {"8rGG\t4g/ 4b~\t.\t*clefF4xx": "8r\t4g 4b\t.\t*clefF4", "=5": "=5"})
    check(spark, T.cue_rest, {"16gg": "16r", "32bb-": "32r", "[4cc": "4r", "8ee 8eee": "8r", "16cc#q": "16qr", "272%3e/": "272%3r", ".": ".", "x": "x"})
    check(spark, T.key_name, {"*k[bnenf#c#]": "*k[f#c#]", "*k[cancel]": "*k[]", "*k[b-e-]": "*k[b-e-]"})
    check(spark, T.clean, {"8rGG": "8r", "4g/": "4g", "8cc\\": "8cc", "4.c~": "4.c", "4c_": "4c_", "48.ff": "32ff", "4cn#": "4c#", "4BnnL": "4Bn", "=12": "=12", "*k[f#]": "*k[f#]", "4cé": "4c"})
    check(spark, lambda c: T.clean(c, ties=False, articulation=True), {"[4.c~": "4.c~", "4c_]": "4c"})


def test_pitches(spark):
    check(spark, T.midi, {"C": 48, "CC": 36, "c": 60, "cc#": 73, "B-": 58, "r": -1, "": -1, "x": -1})
    check(spark, T.respelled, {"f##": "g", "FF##": "GG", "b--": "a", "BB--": "AA", "ee##": "ff#", "c": "c"})
    check(spark, T.strip_naturals, {"ffn": "ff", "CCn": "CC", "4en]": "4e]"})


def test_factors(spark):
    cases = {"4c#": ["4", "c#"], "[8.G": ["[", "8.", "G"], "16r": ["16", "r"], ".": ["."], "24ffd#": ["24", "ff", "24", "d#"], "8bbn": ["8", "bb"], "4ccc#-": ["4", "ccc#"], "4": ["4", "r"], "8qc": ["8", "q", "c"], "4c]": ["4", "c", "]"], "?": []}
    check(spark, T.factors, cases)


def test_durations(spark):
    assert {k: tuple(v) for k, v in each(spark, T.rational, ["4c", "4.c", "8..e", "0r", "00", "12d", "8qc"]).items()} == {"4c": (4, 4), "4.c": (12, 8), "8..e": (28, 32), "0r": (8, 1), "00": (16, 1), "12d": (4, 12), "8qc": (0, 1)}
    check(spark, lambda c: T.rests(c.cast("long")), {"256": "1r", "96": "4.r", "80": "4r 16r", "0": "", "513": "1r 1r 256r"})
    check(spark, lambda c: T.nearest_power(c.cast("long")), {"1": 1, "3": 4, "5": 4, "6": 8, "176": 128, "12": 16, "96": 128})


def test_text_forms(spark):
    check(spark, T.plain_barline, {"=5:|!|:\t=5:|!|:": "=5\t=5", "=:|!|:": "=", "=10!|:": "=10", "4c": "4c"})
    assert each(spark, T.expansion_order, ["*>[A,A, B,B1]", "x"]) == {"*>[A,A, B,B1]": ["A", "A", "B", "B1"], "x": None}
    check(spark, T.tempo, {"quarter = 96": 96, "ca. 72": 72, "Allegro": 138, "Largo 5": 50, "": 120})
    check(spark, lambda c: ids.parse_chunk_id(c)["chunk_index"], {"a#b#c#p.10": 10, "a#p": 0, "a#p.x": 0, "abc.3": 0})
    check(spark, lambda c: ids.parse_chunk_id(c)["piece_id"], {"a#b#c#p.10": "a#b#c", "abc.3": "abc.3"})


def test_strict_is_mean_times_share(spark, sf):
    for r in catalogue.QUERIES["overall_summary"](spark, sf).collect():
        assert math.isclose(r.voice_strict, r.voice_mean * r.n_success / r.n_total, abs_tol=1e-8)


def test_empty_tables(spark, sf):
    none = spark.createDataFrame([], "system string, status string, task_id string, chunk_index int, multi_pitch double, voice double, meter double, value double, harmony double")
    assert summaries.overall(none).count() == 0 and summaries.plain_means(none).collect()[0].mean_voice == 0


def test_transition_fit_equals_newton(spark):
    rng = random.Random(0)
    rows = [("s", rng.random(), rng.randint(0, 1)) for _ in range(600)]
    rows = [(s, p, q, int(rng.random() < 1 / (1 + math.exp(-(-0.5 - p + 2 * q))))) for s, p, q in rows]
    fit = transition.fit(spark.createDataFrame(rows, "system string, position double, previous int, success int")).first()
    x = np.array([[1, p, q] for _, p, q, _ in rows], float)
    y = np.array([r[3] for r in rows], float)
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    assert np.allclose([fit.b0, fit.b1, fit.b2], b, atol=1e-4) and np.allclose([fit.se0, fit.se1, fit.se2], se, atol=1e-4)
    assert fit.severity == ("SEVERE" if fit.or2 > 10 else "MODERATE" if fit.or2 > 3 else "MILD")


def test_marginal_follows_the_fitted_model(spark, sf):
    model = {r.system: r for r in catalogue.QUERIES["transition_model"](spark, sf).collect()}
    path = {(r.system, r.step): r.probability for r in catalogue.QUERIES["fitted_marginal"](spark, sf).collect()}
    assert len(path) == 100 * len(model)
    for system, m in model.items():
        pi = path[system, 0]
        for i in range(1, 100):
            at = lambda b: 1 / (1 + math.exp(-b))
            line = m.b0 + m.b1 * i / 99
            pi = at(line + m.b2) * pi + at(line) * (1 - pi)
            assert abs(path[system, i] - pi) < 1e-6


def test_bootstrap_bands_hold_the_mean(spark):
    df = spark.range(400).select("id", F.lit(1).alias("g"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    r = bands.bootstrap(df, "v", "g", resamples=300).first()
    assert r.low < r.mean < r.high and abs((r.high - r.low) - 2 * 1.96 * math.sqrt(0.25 * 0.75 / 400)) < 0.02
    assert bands.bootstrap(df.limit(4), "v", "g", resamples=10).count() == 0


def test_thinning_equals_the_loop(spark):
    rng = random.Random(3)
    times = sorted(rng.sample(range(5000), 120))
    found = [r.onset_ms for r in notes.thinned(spark.createDataFrame([(1, t) for t in times], "piece_id long, onset_ms long"), 150).orderBy("onset_ms").collect()]
    kept = []
    for t in times:
        if not kept or t - kept[-1] >= 150:
            kept.append(t)
    assert found == kept


def test_pedal_events_and_jitter(spark, sf):
    events = catalogue.QUERIES["pedal_plan"](spark, sf).toPandas()
    assert set(events.event) == {"up", "down"} and (events.at_ms >= 0).all()
    by = events.groupby("piece_id").event.value_counts().unstack()
    assert (by["up"] == by["down"]).all()
    j = catalogue.QUERIES["onset_jitter"](spark, sf).toPandas()
    assert (j.groupby(["piece_id", "onset_ms"]).jitter_ms.nunique() == 1).all() and abs(j.jitter_ms.std() - 5) < 0.7


def test_chunks_equal_the_loop(spark):
    lengths = [0, 1, 11_999, 12_000, 24_000, 24_001, 36_000, 47_999, 48_000, 100_001]
    found = chunking.frame_chunks(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_frames long")).collect()
    want = []
    for i, n in enumerate(lengths):
        start = 0
        while start + 12_000 <= n:
            want.append((i, start, min(start + 24_000, n)))
            if start + 24_000 >= n:
                break
            start += 12_000
    assert sorted((r.doc_id, r.start_frame, r.end_frame) for r in found) == want


def test_rank_plan_covers_all(spark):
    df = spark.range(37).select("id", (F.col("id") % 2).cast("int").alias("bucket"))
    plan = batching.ranked(df, "id", 4, 3).toPandas()
    assert set(plan.id) == set(range(37)) and (plan.groupby(["bucket", "batch", "rank"]).size() == 4).all()


def test_spines_through_split_and_join(spark):
    lines = [(1, 1, ["**a", "**b"]), (1, 2, ["*^", "*"]), (1, 3, ["x", "y", "z"]), (1, 4, ["*v", "*v", "*"]), (1, 5, ["p", "q"]), (1, 6, ["*-", "*"]), (1, 7, ["last"]), (2, 1, ["m", "n"])]
    found = {(r.doc_id, r.line_no, r.column): r.spine for r in spines.assigned(spark.createDataFrame(lines, "doc_id long, line_no long, fields array<string>")).collect()}
    assert [found[1, 3, c] for c in range(3)] == [0, 0, 1] and [found[1, 5, c] for c in range(2)] == [0, 1] and found[1, 7, 0] == 1 and found[2, 1, 1] == 1


def test_score_sequence_and_vocabulary(spark):
    text = ["**kern\t**kern", "*M4/4\t*M4/4", "*k[bnf#c#]\t*k[f#c#]", "=1\t=1", "4c# 4e\t[8.G", "!hint", "2r\t.", "*^\t*", "=2", "*M13/8", "4c", "=3"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line_no long, line string")
    found = [r.token for r in tokens.score_sequence(lines).orderBy("pos").collect()]
    want = "<sos> <bar> <4> 4 <key:2#> 4 c# 4 e <coc> [ 8. G <nl> 2 r <coc> . <nl> <split> <coc> <*> <bar> <4> 4 <key:2#> 4 c <bar> <key:2#> <eos>".split()
    assert found == want
    ids_ = {r.token: r.id for r in tokens.vocabulary(spark).collect()}
    assert len(ids_) == 271
    assert [ids_[t] for t in ("<pad>", "<coc>", "<*>", "<2>", "<key:0>", ".", "0", "CCCC-", "ccccc#", "r", ";")] == [0, 3, 9, 10, 21, 36, 39, 68, 238, 257, 270]


def test_tuplets_by_their_own_size(spark):
    rows = [(1, 0, i, d, "data") for i, d in enumerate([5] * 11 + [18] * 9)] + [(1, 0, 50, 1, "bar"), (1, 0, 51, 5, "data")]
    df = spark.createDataFrame(rows, "doc_id long, spine long, line_no long, dur long, kind string")
    size = examples.group_size(F.col("dur"))
    groups = tokens.complete_tuplets(df, size, size.isNotNull() & (F.col("kind") != "bar"), F.col("kind") == "bar")
    found = examples.plain_tuplets(groups).collect()
    assert sum(r.plain == 6 for r in found) == 12 and sum(r.plain == 20 for r in found) == 10 and sum(r.tie == "[" for r in found) == 3


def test_text_files_at_any_depth(spark, tmp_path):
    for name, body in (("a/x.krn", "one\ntwo\n"), ("a/b/y.krn", "three"), ("z.txt", "no")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    found = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in files.text_lines(spark, str(tmp_path)).collect())
    assert found == [("x.krn", 1, "one"), ("x.krn", 2, "two"), ("y.krn", 1, "three")]


def test_retry_list_skips_comments_and_short_rows(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("# head\na\tt1\ttimeout\nshort\tx\nb\tt2\tmv2h_failed\textra\n")
    assert sorted(tuple(r) for r in files.read_retries(spark, str(tmp_path)).collect()) == [("a", "t1", "timeout"), ("b", "t2", "mv2h_failed")]


def test_cues_follow_their_spine(spark):
    lines = [(1, 1, ["4c", "4e"]), (1, 2, ["*", "*cue"]), (1, 3, ["4c", "8.g#"]), (1, 4, ["*^", "*"]), (1, 5, ["2a", "2b", "[16gg 16bb"]), (1, 6, ["*v", "*v", "*Xcue"]), (1, 7, ["4c", "4d"])]
    found = spines.without_cues(spark.createDataFrame(lines, "doc_id long, line_no long, fields array<string>")).orderBy("line_no", "column").collect()
    got = {n: [r.token for r in found if r.line_no == n] for n in range(1, 8)}
    assert got == {1: ["4c", "4e"], 2: ["*", "*cue"], 3: ["4c", "8.r"], 4: ["*^", "*"], 5: ["2a", "2b", "16r"], 6: ["*v", "*v", "*Xcue"], 7: ["4c", "4d"]}


def test_rows_only_queries_run(spark, sf):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, sf).count() > 0, name


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "scoretables", tmp_path / "scoretables", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for pipeline in (False, True):
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        asked = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
        subprocess.run([sys.executable, "-c", asked], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
