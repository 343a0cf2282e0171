"""Note features, effects and ornaments over the notes view."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoretables.operators import effects as E
from scoretables.operators import notes as N
from scoretables.plans.registry import Family

query = Family()
W = "WINDOW w AS (PARTITION BY piece_id ORDER BY onset_ms, note_idx)"


def r(c, name, digits=9):
    return F.round(c, digits).alias(name)


@query("notes", sql=f"""SELECT piece_id, note_idx, round(avg(dur_ms) OVER (PARTITION BY piece_id ORDER BY onset_ms, note_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS local_mean,
    coalesce(pitch - lag(pitch) OVER w, 0) AS from_previous, coalesce(lead(pitch) OVER w - pitch, 0) AS to_next, coalesce(lag(pitch) OVER w = pitch, false) AS repeated, coalesce(lag(has_fermata) OVER w, false) AS after_fermata,
    round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY piece_id), 9) AS place FROM notes {W}""")  # fmt: skip
def note_features(notes):
    return N.features(notes).select("piece_id", "note_idx", r("local_mean", "local_mean"), "from_previous", "to_next", "repeated", "after_fermata", r("place", "place"))


@query("notes", sql="""SELECT piece_id, note_idx, phrase_start, phrase_end, CASE WHEN phrase_end - phrase_start < 2000 THEN 0.5 ELSE round(least(1.0, greatest(0.0, (onset_ms - phrase_start) / (phrase_end - phrase_start))), 9) END AS phrase_place
    FROM (SELECT *, min(onset_ms) OVER p AS phrase_start, max(onset_ms + dur_ms) OVER p AS phrase_end FROM notes WINDOW p AS (PARTITION BY piece_id, phrase_id))""")  # fmt: skip
def phrase_positions(notes):
    return N.phrase_positions(notes).select("piece_id", "note_idx", "phrase_start", "phrase_end", r("phrase_place", "phrase_place"))


@query("notes", "directions", sql="""SELECT n.piece_id, n.note_idx, min(d.dir_idx) AS dir_idx, 'crescendo' AS kind, round((any_value(n.onset_ms) - min(d.start_ms)) / 1500, 9) AS along
    FROM notes n JOIN directions d ON n.piece_id = d.piece_id AND n.onset_ms >= d.start_ms AND n.onset_ms < d.end_ms GROUP BY ALL""")  # fmt: skip
def active_directions(notes, directions):
    return N.active_directions(notes, directions).withColumn("along", F.round("along", 9))


@query("notes", sql="""SELECT a.piece_id, a.note_idx, count(*) AS n_concurrent, count(*) FILTER (WHERE abs(a.pitch - b.pitch) % 12 IN (1, 2, 6, 10, 11)) AS n_dissonant
    FROM notes a JOIN notes b ON a.piece_id = b.piece_id AND a.note_idx <> b.note_idx AND a.onset_ms >= b.onset_ms - 10 AND a.onset_ms <= b.onset_ms + b.dur_ms + 10 GROUP BY ALL""")  # fmt: skip
def concurrent_notes(notes):
    return N.sounding_together(notes)


@query("notes", sql=f"""SELECT piece_id, note_idx, CASE WHEN abs(a) <= 2 AND abs(b) <= 2 AND a * b > 0 THEN 'passing' WHEN abs(a) <= 2 AND abs(b) <= 2 AND a * b < 0 THEN 'neighbour'
    WHEN abs(a) > 2 AND abs(b) <= 2 AND a * b < 0 THEN 'appoggiatura' WHEN abs(a) <= 2 AND abs(b) > 2 AND a * b < 0 THEN 'escape' ELSE 'none' END AS motion FROM (SELECT *, pitch - lag(pitch) OVER w AS a, lead(pitch) OVER w - pitch AS b FROM notes {W})""")  # fmt: skip
def melodic_motion(notes):
    return N.melodic_motion(notes).select("piece_id", "note_idx", "motion")


@query("notes", sql=f"""SELECT piece_id, note_idx, round(greatest(-1, least(1, 0.03::DOUBLE * (pitch - 60))) + (1 - d * d) + 0.5::DOUBLE * log2(rel), 6) AS db FROM (SELECT *, CASE WHEN place < 0.6::DOUBLE THEN (0.6::DOUBLE - place) / 0.6::DOUBLE ELSE (place - 0.6::DOUBLE) / 0.4::DOUBLE END AS d FROM (
    SELECT *, dur_ms / avg(dur_ms) OVER (PARTITION BY piece_id ORDER BY onset_ms, note_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS rel, CASE WHEN pe - ps < 2000 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (onset_ms - ps) / (pe - ps))) END AS place
    FROM (SELECT *, min(onset_ms) OVER p AS ps, max(onset_ms + dur_ms) OVER p AS pe FROM notes WINDOW p AS (PARTITION BY piece_id, phrase_id))))""")  # fmt: skip
def velocity_effects(notes):
    rows = N.phrase_positions(N.features(notes))
    return rows.select("piece_id", "note_idx", r(N.velocity_db(F.lit(1.0), F.col("phrase_place"), F.col("relative")), "db", 6))


@query("notes", sql="""SELECT piece_id, note_idx, CAST(greatest(1, least(127, floor(CASE WHEN v > 100 THEN 100 + 15 * tanh((v - 100) / 15) ELSE v END + 1e-9::DOUBLE))) AS INTEGER) AS velocity
    FROM (SELECT *, velocity * pow(10, ((pitch - 60) / 20) / 20) AS v FROM notes)""")  # fmt: skip
def velocity_clip(notes):
    return notes.select("piece_id", "note_idx", N.velocity_after(F.col("velocity"), (F.col("pitch") - 60) / 20).alias("velocity"))


@query("notes", sql=f"""SELECT piece_id, note_idx, round(CASE WHEN d < 50 THEN 50 ELSE d END, 6) AS dur_ms FROM (SELECT piece_id, note_idx, dur_ms * (CASE WHEN staccato THEN 0.75::DOUBLE ELSE 1 END) * (CASE WHEN coalesce(lag(pitch) OVER w = pitch, false) THEN 0.9::DOUBLE ELSE 1 END) * (CASE WHEN has_fermata THEN 2 ELSE 1 END) AS d FROM notes {W})""")
def duration_effects(notes):
    rows = N.features(notes)
    return rows.select("piece_id", "note_idx", r(N.least_duration(F.col("dur_ms") * N.duration_factor()), "dur_ms", 6))


@query("notes", sql="""WITH o AS (SELECT piece_id, onset_ms, arg_min(velocity, note_idx) AS step FROM notes GROUP BY ALL), s AS (SELECT piece_id, onset_ms, sum(step) OVER (PARTITION BY piece_id ORDER BY onset_ms)::BIGINT AS drift FROM o)
    SELECT n.piece_id, n.note_idx, s.drift FROM notes n JOIN s USING (piece_id, onset_ms)""".replace("WITH o", "SELECT * FROM (WITH o") + ")")  # fmt: skip
def cumulative_drift(notes):
    return N.drift(notes, F.col("velocity")).select("piece_id", "note_idx", "drift")


@query("notes", sql=f"SELECT piece_id, note_idx, coalesce(sum(CASE WHEN has_fermata THEN dur_ms + 250 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY onset_ms, note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM notes")
def fermata_shift(notes):
    return N.shifted_after(notes, F.when(F.col("has_fermata"), F.col("dur_ms") + 250).otherwise(0)).select("piece_id", "note_idx", "shift")


@query("notes", sql="""SELECT piece_id, note_idx, round(CASE WHEN rest <= 3000 THEN (1 / greatest(sqrt(greatest(0.0::DOUBLE, 1 - 0.5::DOUBLE * (1 - rest / 3000))), 0.9::DOUBLE) - 1) * 500 ELSE 0 END, 6) AS ritard_ms
    FROM (SELECT *, max(onset_ms + dur_ms) OVER (PARTITION BY piece_id) - onset_ms AS rest FROM notes)""")  # fmt: skip
def final_ritard(notes):
    return N.final_ritard(notes).select("piece_id", "note_idx", r("ritard_ms", "ritard_ms", 6))


_BUCKETS = "SELECT piece_id, onset_ms // 600 AS bucket, list_sort(list(DISTINCT pitch % 12)) AS classes, min(onset_ms) AS onset_ms, min(pitch) AS lowest FROM notes GROUP BY ALL"


@query("notes", sql=f"SELECT piece_id, bucket, array_to_string(classes, ',') AS classes, onset_ms, lowest FROM ({_BUCKETS})")
def pitch_class_buckets(notes):
    return N.buckets(notes).withColumn("classes", F.array_join(F.col("classes").cast("array<string>"), ","))


@query("notes", sql=f"""SELECT piece_id, bucket, onset_ms FROM (SELECT *, len(list_intersect(classes, before)) / len(list_distinct(list_concat(classes, before))) AS alike FROM (SELECT *, lag(classes) OVER (PARTITION BY piece_id ORDER BY bucket) AS before FROM ({_BUCKETS})))
    WHERE before IS NULL OR alike < 0.5""")  # fmt: skip
def harmony_changes(notes):
    return N.harmony_changes(N.buckets(notes)).select("piece_id", "bucket", "onset_ms")


@query("notes", sql=f"SELECT piece_id, bucket, lowest FROM (SELECT *, lag(lowest) OVER (PARTITION BY piece_id ORDER BY bucket) AS before FROM ({_BUCKETS}) WHERE lowest < 48) WHERE before IS NULL OR before <> lowest")
def bass_changes(notes):
    return N.bass_changes(N.buckets(notes)).select("piece_id", "bucket", "lowest")


@query("notes", sql="""SELECT e.piece_id, e.bucket, b.bass FROM (SELECT piece_id, unnest(range(min(onset_ms // 1000), max(onset_ms // 1000) + 1)) AS bucket FROM notes GROUP BY piece_id) e
    LEFT JOIN (SELECT piece_id, onset_ms // 1000 AS bucket, min(pitch) FILTER (WHERE pitch < 48) AS bass FROM notes GROUP BY ALL) b USING (piece_id, bucket)""")  # fmt: skip
def bass_of_half_measures(notes):
    """The bass note of each half measure; null where there is none."""
    return N.lowest_notes(notes, 1000)


@query("notes", sql="""SELECT e.piece_id, e.bucket * 2000 AS at_ms, 'up' AS event FROM (SELECT piece_id, unnest(range(min(onset_ms // 2000), max(onset_ms // 2000) + 1)) AS bucket FROM notes GROUP BY piece_id) e
    LEFT JOIN (SELECT DISTINCT piece_id, onset_ms // 2000 AS bucket FROM notes WHERE pitch < 48) b USING (piece_id, bucket) WHERE b.piece_id IS NULL""")  # fmt: skip
def lifts_without_bass(notes):
    return N.lifts_without_bass(notes)


@query("notes", sql=f"""SELECT piece_id, region, count(*) AS n, round(avg(velocity), 9) AS velocity FROM (SELECT n.piece_id, n.velocity, (SELECT count(*) FROM (SELECT piece_id, onset_ms FROM ({_BUCKETS}) WHERE bucket % 4 = 1) c WHERE c.piece_id = n.piece_id AND c.onset_ms <= n.onset_ms) AS region FROM notes n) GROUP BY ALL""")
def region_velocities(notes):
    return N.region_velocities(notes, N.buckets(notes).where("bucket % 4 = 1")).withColumn("velocity", F.round("velocity", 9))


def _thinned(times: str, gap: int) -> str:
    """Common table expressions that end with ``kept``: times at least ``gap`` after the last one kept."""
    return f"times AS ({times}), kept AS (SELECT piece_id, min(onset_ms) AS onset_ms FROM times GROUP BY piece_id UNION ALL SELECT k.piece_id, min(t.onset_ms) FROM kept k JOIN times t ON t.piece_id = k.piece_id AND t.onset_ms >= k.onset_ms + {gap} GROUP BY k.piece_id)"


@query("notes", sql=f"SELECT * FROM (WITH RECURSIVE {_thinned('SELECT DISTINCT piece_id, onset_ms FROM notes', 1150)} SELECT piece_id, onset_ms FROM kept)")
def thinned_changes(notes):
    """Greedy gap."""
    return N.thinned(notes.select("piece_id", "onset_ms"), 1150)


_CHANGES = f"SELECT DISTINCT piece_id, onset_ms FROM (SELECT *, len(list_intersect(classes, before)) / len(list_distinct(list_concat(classes, before))) AS alike FROM (SELECT *, lag(classes) OVER (PARTITION BY piece_id ORDER BY bucket) AS before FROM ({_BUCKETS}))) WHERE before IS NULL OR alike < 0.5"


@query("notes", sql=f"""SELECT * FROM (WITH RECURSIVE {_thinned(_CHANGES, 150)}, o AS (SELECT *, lag(onset_ms) OVER w AS before, lead(onset_ms) OVER w AS after FROM kept WINDOW w AS (PARTITION BY piece_id ORDER BY onset_ms))
    SELECT piece_id, onset_ms + 20 AS at_ms, 'down' AS event FROM o UNION ALL SELECT piece_id, greatest(0, onset_ms - 30), 'up' FROM o WHERE before IS NOT NULL UNION ALL SELECT piece_id, onset_ms + 1000, 'up' FROM o WHERE after IS NULL)""")  # fmt: skip
def pedal_plan(notes):
    """Pedal events at thinned changes."""
    return N.pedal_events(N.thinned(N.harmony_changes(N.buckets(notes)).select("piece_id", "onset_ms")))


# Notes are first moved up by two octaves in every third measure, so that some have no bass.
@query("notes", sql=f"""SELECT * FROM (WITH RECURSIVE moved AS (SELECT * REPLACE (CASE WHEN onset_ms // 2000 % 3 = 1 THEN pitch + 24 ELSE pitch END AS pitch) FROM notes), {_thinned(_CHANGES.replace('FROM notes', 'FROM moved'), 150)},
    high AS (SELECT piece_id, onset_ms // 2000 AS m FROM moved GROUP BY ALL HAVING min(pitch) >= 48), p AS (SELECT DISTINCT piece_id, onset_ms AS t FROM kept UNION SELECT piece_id, m * 2000 FROM high),
    r AS (SELECT p.*, row_number() OVER w AS region, lead(t) OVER w AS after, h.m IS NOT NULL AS no_bass FROM p LEFT JOIN high h ON h.piece_id = p.piece_id AND h.m = p.t // 2000 WINDOW w AS (PARTITION BY p.piece_id ORDER BY t)),
    v AS (SELECT r.*, coalesce(lag(NOT no_bass) OVER (PARTITION BY r.piece_id ORDER BY t), false) AS is_down, coalesce(a.v, 80) AS v FROM r LEFT JOIN (SELECT r.piece_id, r.region, avg(n.velocity) AS v FROM r JOIN moved n ON n.piece_id = r.piece_id AND (n.onset_ms >= r.t OR r.region = 1) AND (n.onset_ms < r.after OR r.after IS NULL) GROUP BY ALL) a ON a.piece_id = r.piece_id AND a.region = r.region)
    SELECT piece_id, greatest(0, t - 30) AS at_ms, 0 AS depth FROM v WHERE is_down
    UNION ALL SELECT piece_id, t + 20, CAST(greatest(40, least(127, floor(50 + greatest(0::DOUBLE, least(1::DOUBLE, (v - 40) / 70)) * least(1::DOUBLE, 500::DOUBLE / 750) * 60 + 1e-9::DOUBLE))) AS INTEGER) FROM v WHERE NOT no_bass
    UNION ALL SELECT piece_id, arg_max(onset_ms + dur_ms, {{'o': onset_ms, 'i': note_idx}}), 0 FROM moved GROUP BY piece_id)""")
def pedalling(notes):
    """Pedal events at all changes, with depth by loudness and none in measures without a bass."""
    moved = notes.withColumn("pitch", F.when(F.floor(F.col("onset_ms") / 2000) % 3 == 1, F.col("pitch") + 24).otherwise(F.col("pitch")))
    return N.pedalling(moved, N.thinned(N.harmony_changes(N.buckets(moved)).select("piece_id", "onset_ms")))


@query("notes", sql="SELECT piece_id, note_idx, k, onset_ms + k * 100 AS onset_ms, pitch + CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END AS pitch FROM (SELECT *, CAST(unnest(range(0, greatest(1, ceil((dur_ms - 50) / 100)::BIGINT))) AS INTEGER) AS k FROM notes WHERE has_fermata)")
def trill_notes(notes):
    return N.trills(notes.where("has_fermata"))


@query("notes", sql="""SELECT piece_id, note_idx, k, CASE k WHEN 0 THEN onset_ms WHEN 1 THEN onset_ms + s ELSE onset_ms + 2 * s END AS onset_ms, CASE WHEN k < 2 THEN s ELSE dur_ms - 2 * s END AS dur_ms, CASE k WHEN 1 THEN pitch - 1 ELSE pitch END AS pitch
    FROM (SELECT *, least(60, dur_ms // 3) AS s, CAST(unnest([0, 1, 2]) AS INTEGER) AS k FROM notes WHERE staccato)""")  # fmt: skip
def mordent_notes(notes):
    return N.mordents(notes.where("staccato"))


@query("notes", sql=f"""WITH p AS (SELECT piece_id, note_idx, onset_ms, pitch, lead(onset_ms) OVER w + lead(dur_ms) OVER w AS end_ms, CASE WHEN note_idx % 3 = 0 THEN pitch ELSE lead(pitch) OVER w END AS other, (velocity + lead(velocity) OVER w) / 2 AS v, note_idx // 2 % 5 AS slashes FROM notes {W}),
    s AS (SELECT *, pitch = other AS one, (end_ms - onset_ms)::DOUBLE AS total, 1000::DOUBLE / CASE WHEN pitch = other THEN CASE slashes WHEN 1 THEN 6 WHEN 3 THEN 10 ELSE 8 END ELSE CASE slashes WHEN 1 THEN 8 WHEN 3 THEN 14 ELSE 11 END END AS step FROM p WHERE note_idx % 2 = 0 AND end_ms IS NOT NULL),
    h AS (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS hit FROM (SELECT *, greatest(4, floor(total / step)::BIGINT) AS n FROM s)),
    o AS (SELECT *, step * (hit + CASE hit WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.08::DOUBLE ELSE 0.12::DOUBLE END) AS off FROM h)
    SELECT piece_id, note_idx, hit, round(onset_ms + off, 6) AS onset_ms, round(least(step * CASE hit WHEN 0 THEN 1.08::DOUBLE WHEN 1 THEN 1.04::DOUBLE ELSE 1 END, total - off) * CASE WHEN one THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END, 6) AS dur_ms, CASE WHEN hit % 2 = 0 THEN pitch ELSE other END AS pitch,
      CAST(floor(greatest(1, least(127, v))) AS INTEGER) AS velocity, round((greatest(0::DOUBLE, least(1::DOUBLE, 1 - 0.6::DOUBLE * pow(2 * hit::DOUBLE / (n - 1) - 1.2::DOUBLE, 2))) - 0.5::DOUBLE) * 2, 6) AS decibels FROM o WHERE off < total""".join(("SELECT * FROM (", ")")))
def tremolo_notes(notes):
    """Every second note with the next one as a tremolo, or alone, with no to four slashes."""
    after = lambda c: F.lead(c).over(N.in_order())
    i = F.col("note_idx")
    pairs = notes.withColumns({
        "end_ms": after("onset_ms") + after("dur_ms"), "other": F.when(i % 3 == 0, F.col("pitch")).otherwise(after("pitch")), "v": (F.col("velocity") + after("velocity")) / 2, "slashes": F.floor(i / 2) % 5,
    }).where("note_idx % 2 = 0 and end_ms is not null").select("piece_id", "note_idx", "onset_ms", "end_ms", "pitch", "other", F.col("v").alias("velocity"), "slashes")
    found = N.tremolos(pairs)
    return found.select("piece_id", "note_idx", "hit", r("onset_ms", "onset_ms", 6), r("dur_ms", "dur_ms", 6), "pitch", "velocity", r("decibels", "decibels", 6))


@query("notes", sql=f"SELECT piece_id, note_idx, onset_ms + taken AS main_onset_ms, dur_ms - taken AS main_dur_ms, CASE WHEN after THEN before END AS grace_pitch, taken AS grace_dur_ms FROM (SELECT *, CASE WHEN after THEN least(80, dur_ms // 2) ELSE 0 END AS taken FROM (SELECT *, lag(pitch) OVER w AS before, coalesce(lag(staccato) OVER w, false) AS after FROM notes {W}))")
def grace_shift(notes):
    return N.grace_notes(notes, F.col("staccato")).select("piece_id", "note_idx", "main_onset_ms", "main_dur_ms", "grace_pitch", "grace_dur_ms")


@query("notes", sql="SELECT piece_id, note_idx, min(onset_ms) AS onset_ms, greatest(1, ceil((any_value(dur_ms) - 50) / 100)::BIGINT) AS n, max(velocity) AS velocity FROM notes GROUP BY ALL")
def collapsed_ornaments(notes):
    fanned = N.trills(notes).join(notes.select("piece_id", "note_idx", "velocity"), ["piece_id", "note_idx"])
    return N.collapsed(fanned)


_UNIT = "((('0x' || substr(digest, {}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


@query("notes", sql=f"SELECT piece_id, note_idx, onset_ms, round(5::DOUBLE * sqrt(-2 * ln({_UNIT.format(1)})) * cos(2 * 3.141592653589793::DOUBLE * {_UNIT.format(14)}), 6) AS jitter_ms FROM (SELECT *, md5(concat(piece_id, '|', onset_ms, '|0')) AS digest FROM notes)")
def onset_jitter(notes):
    """Normal jitter of onsets, drawn from digests."""
    return N.jitter(notes).select("piece_id", "note_idx", "onset_ms", r("jitter_ms", "jitter_ms", 6))


@query("notes", sql="SELECT piece_id, note_idx, CAST(greatest(40, least(127, floor(50 + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (velocity - 40) / 70)) * least(1.0::DOUBLE, dur_ms / 750) * 60 + 1e-9::DOUBLE))) AS INTEGER) AS depth FROM notes")
def pedal_depths(notes):
    return notes.select("piece_id", "note_idx", N.pedal_depth(F.col("velocity"), F.col("dur_ms")).alias("depth"))


@query("notes", sql="""SELECT t.piece_id, t.at_ms, round(CASE WHEN lo.old_ms IS NULL THEN t.at_ms + hi.new_ms - hi.old_ms WHEN hi.old_ms IS NULL OR hi.old_ms = lo.old_ms THEN t.at_ms + lo.new_ms - lo.old_ms ELSE lo.new_ms + (t.at_ms - lo.old_ms) / (hi.old_ms - lo.old_ms) * (hi.new_ms - lo.new_ms) END, 6) AS mapped_ms
    FROM (SELECT DISTINCT piece_id, onset_ms + 120 AS at_ms FROM notes) t ASOF LEFT JOIN (SELECT DISTINCT piece_id, onset_ms AS old_ms, onset_ms + onset_ms // 10 AS new_ms FROM notes WHERE note_idx % 6 = 2) lo ON t.piece_id = lo.piece_id AND t.at_ms >= lo.old_ms
    ASOF LEFT JOIN (SELECT DISTINCT piece_id, onset_ms AS old_ms, onset_ms + onset_ms // 10 AS new_ms FROM notes WHERE note_idx % 6 = 2) hi ON t.piece_id = hi.piece_id AND t.at_ms <= hi.old_ms WHERE lo.old_ms IS NOT NULL OR hi.old_ms IS NOT NULL""")  # fmt: skip
def shifted_pedals(notes):
    pairs = notes.where("note_idx % 6 = 2").select("piece_id", F.col("onset_ms").alias("old_ms"), (F.col("onset_ms") + F.floor(F.col("onset_ms") / 10)).alias("new_ms")).distinct()
    points = notes.select("piece_id", (F.col("onset_ms") + 120).alias("at_ms")).distinct()
    return N.mapped_times(points, pairs).where("mapped_ms is not null").withColumn("mapped_ms", F.round("mapped_ms", 6))


@query("notes", sql="SELECT piece_id, note_idx, CASE WHEN velocity > 0 THEN round(20 * log10(velocity / 64), 9) END AS decibels FROM notes")
def velocity_decibels(notes):
    return notes.select("piece_id", "note_idx", r(N.velocity_decibels(F.col("velocity")), "decibels"))


_K = ", ".join(f"k_{e.name}" for e in E.EFFECTS)
_STRENGTHS = ", ".join("('{}', {})".format(p, ", ".join(f"{E.strength(given, e.name)}::DOUBLE" for e in E.EFFECTS)) for p, given in E.PRESETS.items())
_MARKS = ("staccato", "legato", "tenuto", "accent", "marcato")
_MARK = "CASE note_idx % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + " END"


@query("notes", "directions", sql=f"""WITH s AS (SELECT * FROM (VALUES {_STRENGTHS}) AS v(preset, {_K})),
    f AS (SELECT *, {_MARK} AS mark, dur_ms / avg(dur_ms) OVER (PARTITION BY piece_id ORDER BY onset_ms, note_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS rel, coalesce(lag(pitch) OVER w = pitch, false) AS repeated, pitch - lag(pitch) OVER w AS a, lead(pitch) OVER w - pitch AS b,
      min(onset_ms) OVER p AS ps, max(onset_ms + dur_ms) OVER p AS pe, count(*) OVER ch > 1 AND row_number() OVER (PARTITION BY piece_id, onset_ms ORDER BY pitch DESC, note_idx) = 1 AS top FROM notes WINDOW w AS (PARTITION BY piece_id ORDER BY onset_ms, note_idx), p AS (PARTITION BY piece_id, phrase_id), ch AS (PARTITION BY piece_id, onset_ms)),
    h AS (SELECT n.piece_id, n.note_idx, (any_value(n.onset_ms) - min(d.start_ms)) / 1500 AS hairpin FROM notes n JOIN directions d ON n.piece_id = d.piece_id AND n.onset_ms >= d.start_ms AND n.onset_ms < d.end_ms GROUP BY ALL),
    c AS (SELECT x.piece_id, x.note_idx, count(*) FILTER (WHERE abs(x.pitch - y.pitch) % 12 IN (1, 2, 6, 10, 11)) AS n FROM notes x JOIN notes y ON x.piece_id = y.piece_id AND x.note_idx <> y.note_idx AND x.onset_ms >= y.onset_ms - 10 AND x.onset_ms <= y.onset_ms + y.dur_ms + 10 GROUP BY ALL),
    g AS (SELECT f.*, coalesce(h.hairpin, 0::DOUBLE) AS hairpin, CASE WHEN pe - ps < 2000 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (onset_ms - ps) / (pe - ps))) END AS p,
      least(1::DOUBLE, CASE WHEN abs(a) <= 2 AND abs(b) <= 2 AND a * b <> 0 THEN 0.4::DOUBLE WHEN abs(a) > 2 AND abs(b) <= 2 AND a * b < 0 THEN 0.35::DOUBLE WHEN abs(a) <= 2 AND abs(b) > 2 AND a * b < 0 THEN 0.3::DOUBLE ELSE 0 END + least(0.25::DOUBLE, 0.1::DOUBLE * coalesce(c.n, 0))
        + CASE WHEN onset_ms % 500 <> 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN rel < 0.5::DOUBLE THEN 0.15::DOUBLE ELSE 0 END) AS charge FROM f LEFT JOIN h USING (piece_id, note_idx) LEFT JOIN c USING (piece_id, note_idx)),
    d AS (SELECT g.*, CASE WHEN p < 0.6::DOUBLE THEN (0.6::DOUBLE - p) / 0.6::DOUBLE ELSE (p - 0.6::DOUBLE) / 0.4::DOUBLE END AS away FROM g),
    e AS (SELECT s.preset, d.*, greatest(-1::DOUBLE, least(1::DOUBLE, 0.03::DOUBLE * k_high_loud * (pitch - 60))) + k_phrase_arch * (1 - away * away) + 0.5::DOUBLE * k_duration_contrast * log2(rel) + 2 * k_melodic_charge * charge + 3 * k_crescendo * hairpin
        + CASE mark WHEN 'tenuto' THEN k_tenuto WHEN 'accent' THEN 1.5::DOUBLE * k_accent * least(1::DOUBLE, dur_ms / 500) WHEN 'marcato' THEN 5 * k_marcato ELSE 0 END AS db,
      -k_rubato * least(1.5::DOUBLE, pow(100 / 120, 2)) * CASE WHEN p < 0.6::DOUBLE THEN -0.1::DOUBLE + 0.2::DOUBLE * p / 0.6::DOUBLE ELSE 0.1::DOUBLE - 0.25::DOUBLE * (p - 0.6::DOUBLE) / 0.4::DOUBLE END * 250 - 0.1::DOUBLE * k_crescendo * hairpin * 500 + CASE mark WHEN 'accent' THEN 20 * k_agogic + k_accent_delay WHEN 'tenuto' THEN 15 * k_articulation_tempo WHEN 'legato' THEN 5 * k_articulation_tempo ELSE 0 END - CASE WHEN top THEN 25 * k_chord_lead ELSE 0 END AS own,
      CASE WHEN onset_ms = ps AND phrase_id > 0 THEN 20 * k_punctuation ELSE 0 END AS step,
      dur_ms * CASE WHEN has_fermata THEN 1 + k_fermata ELSE 1 END * CASE WHEN onset_ms + dur_ms = pe THEN 1 - 0.15::DOUBLE * k_punctuation ELSE 1 END * CASE WHEN repeated THEN 1 - 0.1::DOUBLE * k_repetition ELSE 1 END * CASE mark WHEN 'staccato' THEN 1 - 0.25::DOUBLE * k_staccato WHEN 'legato' THEN 1 + least(30 * k_legato, 0.1::DOUBLE * dur_ms) / dur_ms
        WHEN 'tenuto' THEN 1 + 0.05::DOUBLE * k_tenuto WHEN 'marcato' THEN 1 - 0.05::DOUBLE * k_marcato ELSE 1 END AS dur FROM d CROSS JOIN s),
    o AS (SELECT *, row_number() OVER (PARTITION BY preset, piece_id, onset_ms ORDER BY note_idx) AS nth FROM e)
    SELECT preset, piece_id, note_idx, round(db, 6) AS decibels, round(own + sum(CASE WHEN nth = 1 THEN step ELSE 0 END) OVER (PARTITION BY preset, piece_id ORDER BY onset_ms), 6) AS shift_ms, round(CASE WHEN dur < 50 THEN 50 ELSE dur END, 6) AS dur_ms FROM o""".join(("SELECT * FROM (", ")")))  # fmt: skip
def preset_performances(notes, directions):
    """Every note under every preset: gain, shift in time and duration of all effects together."""
    i = F.col("note_idx") % 7
    mark = F.lit(None).cast("string")
    for k, name in enumerate(_MARKS):
        mark = F.when(i == k, name).otherwise(mark)
    found = E.applied(E.prepared(notes.withColumn("mark", mark), directions), E.presets(notes.sparkSession))
    return found.select("preset", "piece_id", "note_idx", r(F.col("decibels"), "decibels", 6), r(F.col("shift_ms"), "shift_ms", 6), r(F.col("dur_ms"), "dur_ms", 6))


@query("notes", sql="SELECT piece_id, note_idx, round(avg(dur_ms) OVER (PARTITION BY piece_id ORDER BY onset_ms, note_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS local_mean, onset_ms + 100 AS onset_ms FROM notes")
def transformed_notes(notes):
    """A caller's own step in the chain, by ``DataFrame.transform``."""
    later = lambda df, ms: df.withColumn("onset_ms", F.col("onset_ms") + ms)
    return notes.transform(N.features).transform(later, 100).select("piece_id", "note_idx", r("local_mean", "local_mean"), "onset_ms")


QUERIES, ORACLE_SQL = query.queries, query.sql
