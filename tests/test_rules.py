"""Operators by hand and against loops: headers, maps, searches, bands, draws, joined notes, tremolos, effects, numbering."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scoretables.functions import tokens as T
from scoretables.operators import bands, batching, corpus, effects, examples, notes, repeats, segments


def test_header_kinds_by_hand(spark):
    lines = {
        1: ["**kern", "*MM90/x", "*M4/4\t*M3/4", "*M3/4", "*MM120/y", "*MM80", "*k[f#]", "*clefG2", "*staff1", "*Ivox", "=", "==", "=:|!", "=7-\t=7", "=8"],
        2: ["*^\t*", "*v\t*v", "4c", "!*k[]", "  *k[]\t*  ", "*MM60", "*-"],
        3: ["=12a"],
    }
    df = spark.createDataFrame([(d, n, x) for d, ls in lines.items() for n, x in enumerate(ls)], "doc_id long, line_no long, line string")
    found = {r.doc_id: r for r in segments.metadata(df).collect()}
    # A tempo with a slash stands for the meter as long as there is none.
    assert (found[1].time_sig, found[1].tempo, found[1].first_measure) == ("*MM90/x", "*MM120/y", 7)
    assert (found[1].key_sig, found[1].clef, found[1].staff, found[1].instrument) == ("*k[f#]", "*clefG2", "*staff1", "*Ivox")
    assert (found[2].time_sig, found[2].key_sig, found[2].tempo, found[2].first_measure, found[2].clef) == (None, "  *k[]\t*  ", "*MM60", None, None)
    assert found[3].first_measure == 12


def test_maps_shorter_and_longer_than_their_scores(spark):
    mapping = spark.createDataFrame([(1, 0, 5, "A"), (1, 1, 6, "B"), (2, 0, 9, "A"), (2, 1, 8, "A"), (2, 2, 7, "C")], "doc_id long, pos long, original long, section string")
    measures = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 0, 1), (2, 1, 2), (3, 0, 4)], "doc_id long, pos long, measure long")
    rows = lambda **o: sorted((r.doc_id, r.pos, r.original, r.section) for r in repeats.aligned(mapping, measures, **o).collect())
    both = [(2, 0, 9, "A"), (2, 1, 8, "A"), (3, 0, 4, "")]
    key = lambda r: (r[0], r[1])
    assert sorted(rows(), key=key) == [(1, 0, 5, "A"), (1, 1, 6, "B"), (1, 2, None, ""), (1, 3, None, ""), *both]
    assert rows(inherit=True) == [(1, 0, 5, "A"), (1, 1, 6, "B"), (1, 2, 6, "B"), (1, 3, 6, "B"), *both]


def test_search_equals_contains(spark):
    rng = random.Random(0)
    paths = ["/".join("".join(rng.choices("ab_1é", k=rng.randint(1, 4))) for _ in range(3)) for _ in range(150)]
    texts = {p[a : a + k] for p in paths[:80] for a, k in [(rng.randrange(3), rng.randint(1, 7))]} | {"zz", "a", "b/", "not there", "", paths[0], paths[1] + "x", "_1_"}
    found = corpus.containing(spark.createDataFrame([(t,) for t in texts], "wanted string"), spark.createDataFrame([(p,) for p in paths] + [("",)], "path string"))
    assert {r.wanted: r.path for r in found.collect()} == {t: min((p for p in paths if t and t in p), default=None) for t in texts}
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_resamples(spark):
    df = spark.range(400).select(F.lit(1).alias("g"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    r = bands.resampled(df, "v", "g", resamples=600).first()
    width = 2 * 1.96 * math.sqrt(0.25 * 0.75 / 400)
    assert (r.n, r.mean) == (400, 0.25) and r.low < r.mean < r.high and abs((r.high - r.low) - width) < 0.012
    assert bands.resampled(df.limit(4), "v", "g", resamples=10).count() == 0
    draws = spark.range(1, 201).withColumnRenamed("id", "k").crossJoin(spark.range(1, 101)).select((bands.draw(F.col("k"), F.col("id")) % 10).alias("d"))
    counts = [r["count"] for r in draws.groupBy("d").count().collect()]
    assert len(counts) == 10 and all(abs(c - 2000) < 250 for c in counts)

    # Means of the resamples by a loop over the same draws.
    rows = [(1, 0.5)] * 2 + [(1, 0.25)] * 3 + [(1, 1.0)] * 4
    order = sorted(v for _, v in rows)

    def draw(resample, j):
        u = (resample * 48_271 + j * 69_621 + 12_345) % (2**31 - 1)
        for k in range(3):
            u = (u * u + 40_692 * (j + k) + resample) % (2**31 - 1)
        return u

    means = sorted(sum(order[draw(k, j) % 9] for j in range(1, 10)) / 9 for k in range(1, 41))
    at = lambda q: means[int(q * 39)] + (q * 39 - int(q * 39)) * (means[int(q * 39) + 1] - means[int(q * 39)])
    r = bands.resampled(spark.createDataFrame(rows, "g long, v double"), "v", "g", resamples=40).first()
    assert abs(r.low - at(0.025)) < 1e-12 and abs(r.high - at(0.975)) < 1e-12


def test_bands_of_many_rows(spark):
    """A million rows and a thousand resamples: a row for each draw would take minutes."""
    import time

    df = spark.range(1_000_000).select(F.lit("a").alias("g"), (F.col("id") % 4 == 0).cast("int").alias("v"))
    width = 2 * 1.96 * math.sqrt(0.25 * 0.75 / 1_000_000)
    for f in (bands.bootstrap, bands.resampled):
        began = time.time()
        r = f(df, "v", "g").first()
        assert (r.n, r.mean) == (1_000_000, 0.25) and r.low < r.mean < r.high and abs((r.high - r.low) / width - 1) < 0.1, f
        assert time.time() - began < 45, f


def test_drawn_values_fill_their_ranges(spark):
    rows = examples.drawn(spark.range(2000).select(F.col("id").cast("string").alias("stem")), "stem", {"a": (0.5, 1.5), "b": (-1.0, 0.0)}).collect()
    for name, low in (("a", 0.5), ("b", -1.0)):
        values = [r[name] for r in rows]
        assert low <= min(values) < low + 0.01 and low + 0.99 < max(values) < low + 1 and abs(sum(values) / 2000 - low - 0.5) < 0.03


def test_joined_notes(spark):
    cases = {"4r4G-": ["4r", "4G-"], "16c#0": ["16c#"], "24ffd#": ["24ffd#"], "8cL8eJ": ["8c", "8e"], "4": ["4"], "": [""], "[4c]8d": ["[4c]8d"], "2.e-16n": ["2.e-"], "1c2d4e": ["1c", "2d", "4e"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.s for r in df.select("t", T.split_notes(df.t).alias("s")).collect()} == cases


def test_tremolos_by_hand(spark):
    schema = "name string, onset_ms long, end_ms long, pitch long, other long, velocity double, slashes int"
    rows = [("two", 0, 1000, 60, 64, 70.0, 1), ("one", 100, 1100, 60, 60, 70.5, 3), ("short", 0, 200, 60, 62, 0.0, 2), ("none", 5, 5, 60, 62, 64.0, 2), ("odd", 0, 2000, 60, 62, 300.0, None)]
    found = {}
    for r in sorted(notes.tremolos(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.hit):
        found.setdefault(r.name, []).append(r)
    two = found["two"]
    assert [r.pitch for r in two] == [60, 64] * 4 and [r.onset_ms for r in two][:4] == pytest.approx([0, 135, 265, 390]) and two[0].dur_ms == pytest.approx(135 * 0.95)
    assert two[-1].onset_ms + two[-1].dur_ms / 0.95 <= 1000 + 1e-9 and two[4].decibels == pytest.approx((1 - 0.6 * (2 * 4 / 7 - 1.2) ** 2 - 0.5) * 2)
    assert len(found["one"]) == 10 and {r.pitch for r in found["one"]} == {60} and found["one"][5].dur_ms == pytest.approx(85) and found["one"][0].velocity == 70
    assert len(found["short"]) == 3 and found["short"][-1].onset_ms < 200 and found["short"][0].velocity == 1  # four are asked for, as far as the time lasts
    assert "none" not in found and len(found["odd"]) == 22 and found["odd"][0].velocity == 127


def test_settings_for_each_piece_and_too_many_of_them(spark):
    schema = "piece_id long, note_idx long, onset_ms long, pitch long, dur_ms long, velocity long, phrase_id long, has_fermata boolean, mark string"
    rows = [(p, i, i // 2 * 500, 60 + i, 400, 64, 0, i == 3, "accent" if i == 2 else "tenuto" if i == 4 else None) for p in (1, 2) for i in range(8)]
    prepared = effects.prepared(spark.createDataFrame(rows, schema), spark.createDataFrame([], "piece_id long, dir_idx long, kind string, start_ms long, end_ms long"))
    names = [e.name for e in effects.EFFECTS]
    only = lambda **k: [float(k.get(n, 0.0)) for n in names]
    columns = ", ".join(f"k_{n} double" for n in names)
    strengths = spark.createDataFrame([("v1", 1, *only(chord_lead=1, agogic=1, fermata=1)), ("v2", 2, *only(accent_delay=7, articulation_tempo=2))], f"preset string, piece_id long, {columns}")
    found = {(r.piece_id, r.note_idx): r for r in effects.applied(prepared, strengths).collect()}
    assert len(found) == 16 and {r.preset for r in found.values()} == {"v1", "v2"}
    assert [found[1, i].shift_ms for i in range(6)] == [0, -25, 20, -25, 0, -25] and found[1, 3].dur_ms == 800
    assert [found[2, i].shift_ms for i in range(6)] == [0, 0, 7, 0, 30, 0] and found[2, 3].dur_ms == 400
    many = spark.createDataFrame([(f"p{i}", *only()) for i in range(effects.MOST_SETTINGS + 1)], f"preset string, {columns}")
    with pytest.raises(ValueError, match="piece_id"):
        effects.applied(prepared, many)
    assert {effects.strength(p, "accent_delay") for p in effects.PRESETS.values()} == {0.0}


def test_numbers_are_the_same_in_one_task_and_in_ranges(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("bucket"), F.md5(F.col("id").cast("string")).alias("stem"))
    at = lambda: sorted(tuple(r) for r in batching.numbered(rows, F.substring("stem", 1, 1), "stem").select("bucket", "stem", "_at", "_n").collect())
    one = at()
    monkeypatch.setattr(batching, "ONE_TASK", 10)
    assert at() == one and {r[3] for r in one} == {1000}
    assert batching.numbered(rows.where("false"), F.col("stem"), "stem").count() == 0
