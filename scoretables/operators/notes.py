"""Note tables: neighbours, intervals in time, effects, harmony changes, ornaments. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order() -> Window:
    """The notes of a piece by onset, then number."""
    return Window.partitionBy("piece_id").orderBy("onset_ms", "note_idx")


def features(notes: DataFrame) -> DataFrame:
    """Local mean duration (five notes either side) and the ratio to it, intervals to neighbours, place in the piece."""
    near = in_order().rowsBetween(-5, 5)
    before, after = F.lag("pitch").over(in_order()), F.lead("pitch").over(in_order())
    return notes.withColumns({
        "local_mean": F.avg("dur_ms").over(near), "relative": F.col("dur_ms") / F.avg("dur_ms").over(near),
        "from_previous": F.coalesce(F.col("pitch") - before, F.lit(0)), "to_next": F.coalesce(after - F.col("pitch"), F.lit(0)),
        "repeated": F.coalesce(before == F.col("pitch"), F.lit(False)), "after_fermata": F.coalesce(F.lag("has_fermata").over(in_order()), F.lit(False)),
        "place": (F.row_number().over(in_order()) - 1) / F.count("*").over(Window.partitionBy("piece_id")),
    })


def phrase_positions(notes: DataFrame, least_ms: int = 2000) -> DataFrame:
    """Place of each note in its phrase from 0 to 1; 0.5 in phrases shorter than ``least_ms``."""
    phrase = Window.partitionBy("piece_id", "phrase_id")
    start, end = F.min("onset_ms").over(phrase), F.max(F.col("onset_ms") + F.col("dur_ms")).over(phrase)
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("onset_ms") - start) / (end - start)))
    return notes.withColumns({"phrase_start": start, "phrase_end": end, "phrase_place": F.when(end - start < least_ms, 0.5).otherwise(place)})


def active_directions(notes: DataFrame, directions: DataFrame, width: int = 4000) -> DataFrame:
    """The first direction (by its number) active at each onset, and how far along it is; by buckets of ``width`` ms."""
    spans = directions.select("piece_id", "dir_idx", "kind", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.greatest("start_ms", F.col("end_ms") - 1) / width))).alias("bucket"))
    met = notes.select("piece_id", "note_idx", "onset_ms", F.floor(F.col("onset_ms") / width).alias("bucket")).join(spans, ["piece_id", "bucket"]).where("onset_ms >= start_ms and onset_ms < end_ms")
    first = met.groupBy("piece_id", "note_idx", "onset_ms").agg(F.min_by(F.struct("dir_idx", "kind", "start_ms", "end_ms"), "dir_idx").alias("d"))
    along = F.coalesce(F.try_divide(F.col("onset_ms") - F.col("d.start_ms"), F.col("d.end_ms") - F.col("d.start_ms")), F.lit(0.0))
    return first.select("piece_id", "note_idx", "d.dir_idx", "d.kind", along.alias("along"))


def sounding_together(notes: DataFrame, slack_ms: int = 10, width: int = 2000) -> DataFrame:
    """Number of other notes that sound at each note's onset (within the slack), by buckets of ``width`` ms."""
    spans = notes.select("piece_id", F.col("note_idx").alias("other"), F.col("pitch").alias("other_pitch"), (F.col("onset_ms") - slack_ms).alias("from"), (F.col("onset_ms") + F.col("dur_ms") + slack_ms).alias("to"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.col("to") / width))))
    at = notes.select("piece_id", "note_idx", "pitch", "onset_ms", F.floor(F.col("onset_ms") / width).alias("bucket"))
    met = at.join(spans, ["piece_id", "bucket"]).where("onset_ms >= `from` and onset_ms <= `to` and note_idx <> other")
    harsh = F.pmod(F.abs(F.col("pitch") - F.col("other_pitch")), F.lit(12)).isin(1, 2, 6, 10, 11)
    return met.groupBy("piece_id", "note_idx").agg(F.count("*").alias("n_concurrent"), F.count_if(harsh).alias("n_dissonant"))


def melodic_motion(notes: DataFrame) -> DataFrame:
    """Kind of motion through each note by its steps: passing, neighbour, appoggiatura, escape, or none."""
    a, b = F.col("pitch") - F.lag("pitch").over(in_order()), F.lead("pitch").over(in_order()) - F.col("pitch")
    step, turns = lambda x: F.abs(x) <= 2, a * b < 0
    motion = F.when(step(a) & step(b) & (a * b > 0), "passing").when(step(a) & step(b) & turns, "neighbour").when(~step(a) & step(b) & turns, "appoggiatura").when(step(a) & ~step(b) & turns, "escape").otherwise("none")
    score = F.when(motion.isin("passing", "neighbour"), 0.4).when(motion == "appoggiatura", 0.35).when(motion == "escape", 0.3).otherwise(0.0)
    return notes.withColumns({"motion": motion, "motion_score": score})


def velocity_db(k: Column | float, phrase_place: Column, relative: Column) -> Column:
    """Decibels of the additive velocity effects of strength ``k``: high and loud, phrase arch, duration contrast."""
    high = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.03 * k * (F.col("pitch") - 60)))
    d = F.when(phrase_place < 0.6, (0.6 - phrase_place) / 0.6).otherwise((phrase_place - 0.6) / 0.4)
    return high + k * (1 - d * d) + 0.5 * k * F.log2(relative)


def velocity_after(velocity: Column, db: Column) -> Column:
    """Velocity after a gain: softly clipped above 100, then a whole number from 1 to 127."""
    v = velocity * F.pow(F.lit(10.0), db / 20)
    soft = F.when(v > 100, 100 + 15 * F.tanh((v - 100) / 15)).otherwise(v)
    return F.greatest(F.lit(1), F.least(F.lit(127), F.floor(soft + 1e-9))).cast("int")


def duration_factor(k: float = 1.0) -> Column:
    """Product of the multiplicative duration effects of each note."""
    return F.when(F.col("staccato"), 1 - 0.25 * k).otherwise(1.0) * F.when(F.col("repeated"), 1 - 0.1 * k).otherwise(1.0) * F.when(F.col("has_fermata"), 1 + k).otherwise(1.0)


def least_duration(dur: Column, k: float = 1.0, floor_ms: int = 50) -> Column:
    return F.when(dur < floor_ms, dur + k * (floor_ms - dur)).otherwise(dur)


def drift(notes: DataFrame, offset: Column) -> DataFrame:
    """Cumulative tempo drift: each new onset adds the offset of its first note; notes of one onset share it."""
    first = F.row_number().over(Window.partitionBy("piece_id", "onset_ms").orderBy("note_idx")) == 1
    once = notes.withColumn("step", F.when(first, offset).otherwise(0))
    total = F.sum("step").over(Window.partitionBy("piece_id").orderBy("onset_ms").rangeBetween(Window.unboundedPreceding, 0))
    return once.withColumn("drift", total).drop("step")


def shifted_after(notes: DataFrame, extra: Column) -> DataFrame:
    """``shift``: what the notes before this one add."""
    return notes.withColumn("shift", F.coalesce(F.sum(extra).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def final_ritard(notes: DataFrame, measure_ms: int = 2000, beat_ms: int = 500, k: float = 0.5) -> DataFrame:
    """Delay in ms of the notes in the last measures: tempo falls as the root of 1 - k x, to a floor."""
    end = F.max(F.col("onset_ms") + F.col("dur_ms")).over(Window.partitionBy("piece_id"))
    span = (2 + k - 1) * measure_ms
    x = 1 - (end - F.col("onset_ms")) / span
    v = F.greatest(F.sqrt(F.greatest(F.lit(0.0), 1 - k * x)), F.lit(max(0.8 - 0.2 * (k - 1), 0.2)))
    return notes.withColumn("ritard_ms", F.when(end - F.col("onset_ms") <= span, (1 / v - 1) * beat_ms).otherwise(0.0))


def buckets(notes: DataFrame, width: int = 600) -> DataFrame:
    """Pitch classes, earliest onset and lowest pitch of each stretch of ``width`` ms."""
    return notes.groupBy("piece_id", F.floor(F.col("onset_ms") / width).alias("bucket")).agg(F.array_sort(F.collect_set(F.col("pitch") % 12)).alias("classes"), F.min("onset_ms").alias("onset_ms"), F.min("pitch").alias("lowest"))


def harmony_changes(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Buckets whose pitch classes share less than ``least`` (Jaccard) with the bucket before; the first always."""
    before = F.lag("classes").over(Window.partitionBy("piece_id").orderBy("bucket"))
    alike = F.size(F.array_intersect(before, "classes")) / F.size(F.array_union(before, "classes"))
    return found.withColumn("alike", alike).where(F.col("alike").isNull() | (F.col("alike") < least))


def lowest_notes(notes: DataFrame, width: int, below: int = 48) -> DataFrame:
    """The lowest pitch under ``below`` of each stretch of ``width`` ms of a piece, from its first to its last; null where there is none."""
    bass = notes.groupBy("piece_id", F.floor(F.col("onset_ms") / width).alias("bucket")).agg(F.min(F.when(F.col("pitch") < below, F.col("pitch"))).alias("bass"))
    ends = bass.groupBy("piece_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = ends.select("piece_id", F.explode(F.sequence("a", "b")).alias("bucket"))
    return every.join(bass, ["piece_id", "bucket"], "left")


def lifts_without_bass(notes: DataFrame, measure_ms: int = 2000, below: int = 48) -> DataFrame:
    """Pedal lifts at the start of each measure that has no bass note."""
    empty = lowest_notes(notes, measure_ms, below).where("bass is null")
    return empty.select("piece_id", (F.col("bucket") * measure_ms).alias("at_ms"), F.lit("up").alias("event"))


def bass_changes(found: DataFrame, below: int = 48) -> DataFrame:
    """Buckets with a bass note of another pitch than the bass before; buckets without a bass are passed over."""
    order = Window.partitionBy("piece_id").orderBy("bucket")
    return found.where(F.col("lowest") < below).withColumn("before", F.lag("lowest").over(order)).where("before is null or before <> lowest").drop("before")


def region_velocities(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Mean velocity from each change to the next: an as-of join in one ordered pass; notes before all are region 0."""
    both = changes.select("piece_id", "onset_ms", F.lit(0).alias("side"), F.lit(1).alias("step"), F.lit(None).cast("long").alias("velocity")).unionByName(
        notes.select("piece_id", "onset_ms", F.lit(1).alias("side"), F.lit(0).alias("step"), F.col("velocity").cast("long").alias("velocity"))
    )
    region = F.sum("step").over(Window.partitionBy("piece_id").orderBy("onset_ms", "side"))
    return both.withColumn("region", region).where("side = 1").groupBy("piece_id", "region").agg(F.count("*").alias("n"), F.avg("velocity").alias("velocity"))


def thinned(times: DataFrame, gap_ms: int = 150) -> DataFrame:
    """Times kept greedily, each at least ``gap_ms`` after the last one kept. A fold over a piece's sorted times, which
    a piece bounds."""
    every = times.groupBy("piece_id").agg(F.array_sort(F.collect_set("onset_ms")).alias("ts"))
    keep = F.aggregate("ts", F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= gap_ms), F.array_append(acc, t)).otherwise(acc))
    return every.select("piece_id", F.explode(keep).alias("onset_ms"))


def pedal_events(changes: DataFrame, lift_ms: int = 30, press_ms: int = 20) -> DataFrame:
    """Pedal up before and down after each change (only down at the first), with a last lift at the end."""
    order = Window.partitionBy("piece_id").orderBy("onset_ms")
    event = lambda t, what: F.struct(F.greatest(F.lit(0).cast("long"), t).alias("at_ms"), F.lit(what).alias("event"))
    first, last = F.lag("onset_ms").over(order).isNull(), F.lead("onset_ms").over(order).isNull()
    t = F.col("onset_ms")
    down = event(t + press_ms, "down")
    rows = changes.withColumns({"first": first, "last": last})
    events = F.concat(F.when(F.col("first"), F.array(down)).otherwise(F.array(event(t - lift_ms, "up"), down)), F.when(F.col("last"), F.array(event(t + 1000, "up"))).otherwise(F.slice(F.array(down), 1, 0)))
    return rows.select("piece_id", F.explode(events).alias("e")).select("piece_id", "e.at_ms", "e.event")


def pedalling(notes: DataFrame, changes: DataFrame, measure_ms: int = 2000, below: int = 48, lift_ms: int = 30, press_ms: int = 20, beat_ms: float = 500.0) -> DataFrame:
    """All pedal events of each piece: ``at_ms`` and ``depth``, 0 for a lift.

    The pedal is lifted before and pressed after each change (``onset_ms``), deeper where the notes up to the next change
    are louder. Measures whose notes are all at or above ``below`` begin with a change at which it is lifted, if it is
    down, and not pressed; so do changes inside them. It is lifted at the end of the last note.
    """
    measure = lambda t: F.floor(t / measure_ms)
    high = notes.groupBy("piece_id", measure(F.col("onset_ms")).alias("measure")).agg(F.min("pitch").alias("lowest")).where(F.col("lowest") >= below).select("piece_id", "measure")
    begins = high.join(changes.select("piece_id").distinct(), "piece_id", "left_semi").select("piece_id", (F.col("measure") * measure_ms).alias("onset_ms"))
    points = changes.select("piece_id", "onset_ms").unionByName(begins).distinct()
    order = Window.partitionBy("piece_id").orderBy("onset_ms")
    regions = points.withColumn("region", F.row_number().over(order).cast("long"))
    loud = region_velocities(notes, points)
    # Notes before the first change count for it.
    loud = loud.groupBy("piece_id", F.greatest("region", F.lit(1)).cast("long").alias("region")).agg((F.sum(F.col("velocity") * F.col("n")) / F.sum("n")).alias("velocity"))
    rows = regions.join(loud, ["piece_id", "region"], "left").withColumn("measure", measure(F.col("onset_ms"))).join(high.withColumn("no_bass", F.lit(True)), ["piece_id", "measure"], "left")
    rows = rows.withColumn("no_bass", F.coalesce("no_bass", F.lit(False))).withColumn("is_down", F.coalesce(F.lag(~F.col("no_bass")).over(order), F.lit(False)))
    event = lambda t, depth: F.struct(t.cast("long").alias("at_ms"), depth.cast("int").alias("depth"))
    up = event(F.greatest(F.lit(0).cast("long"), F.col("onset_ms") - lift_ms), F.lit(0))
    down = event(F.col("onset_ms") + press_ms, pedal_depth(F.coalesce("velocity", F.lit(80.0)), F.lit(beat_ms)))
    events = F.array_compact(F.array(F.when(F.col("is_down"), up), F.when(~F.col("no_bass"), down)))
    end = notes.join(changes.select("piece_id").distinct(), "piece_id", "left_semi").groupBy("piece_id").agg(F.max_by(F.col("onset_ms") + F.col("dur_ms"), F.struct("onset_ms", "note_idx")).cast("long").alias("at_ms"))
    return rows.select("piece_id", F.explode(events).alias("e")).select("piece_id", "e.at_ms", "e.depth").unionByName(end.select("piece_id", "at_ms", F.lit(0).alias("depth")))


def trills(notes: DataFrame, note_ms: int = 100, interval: int = 2) -> DataFrame:
    """Alternating notes that fill each note: ceil((dur - half) / length) of them, from the written pitch."""
    n = F.greatest(F.lit(1), F.ceil((F.col("dur_ms") - note_ms / 2) / note_ms)).cast("int")
    rows = notes.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("piece_id", "note_idx", "k", (F.col("onset_ms") + F.col("k") * note_ms).alias("onset_ms"), (F.col("pitch") + F.when(F.col("k") % 2 == 1, interval).otherwise(0)).alias("pitch"))


def mordents(notes: DataFrame, note_ms: int = 60, interval: int = -1) -> DataFrame:
    """Three notes for one: the pitch, its neighbour, and the pitch for the rest."""
    part = lambda k, start, dur, pitch: F.struct(F.lit(k).alias("k"), start.cast("long").alias("onset_ms"), dur.cast("long").alias("dur_ms"), pitch.cast("long").alias("pitch"))
    t, short = F.col("onset_ms"), F.least(F.lit(note_ms), F.floor(F.col("dur_ms") / 3))
    parts = F.array(part(0, t, short, F.col("pitch")), part(1, t + short, short, F.col("pitch") + interval), part(2, t + 2 * short, F.col("dur_ms") - 2 * short, F.col("pitch")))
    return notes.select("piece_id", "note_idx", F.explode(parts).alias("p")).select("piece_id", "note_idx", "p.*")


def melody(notes: DataFrame) -> DataFrame:
    """``is_melody``: whether a note is the highest (of equal ones the first) of several that begin together."""
    chord = Window.partitionBy("piece_id", "onset_ms")
    first = F.row_number().over(chord.orderBy(F.desc("pitch"), "note_idx")) == 1
    return notes.withColumn("is_melody", first & (F.count("*").over(chord) > 1))


# Hits a second by slashes, for one key and for two; the share of a hit that sounds.
SLASHES_ONE, SLASHES_TWO = {1: 6.0, 2: 8.0, 3: 10.0}, {1: 8.0, 2: 11.0, 3: 14.0}
SOUNDS_ONE, SOUNDS_TWO = 0.85, 0.95


def tremolos(pairs: DataFrame, k: float = 1.0) -> DataFrame:
    """The hits of a tremolo between two notes, or of one repeated: ``hit``, ``onset_ms``, ``dur_ms``, ``pitch``,
    ``velocity`` and ``decibels``.

    Slashes set the rate; there are at least four hits, as far as the time lasts. The first two are slower by 8 and 4
    per cent, loudness is an arch with its peak at 0.6, pitches alternate, and every hit ends with a gap. ``pairs``:
    onset_ms, end_ms, pitch, other, velocity, slashes.
    """
    one = F.col("pitch") == F.col("other")
    by_slashes = lambda table: F.coalesce(*(F.when(F.col("slashes") == n, F.lit(hz)) for n, hz in table.items()), F.lit(table[2]))
    step = 1000 / F.when(one, by_slashes(SLASHES_ONE)).otherwise(by_slashes(SLASHES_TWO))
    rows = pairs.withColumns({"step": step, "total": F.col("end_ms") - F.col("onset_ms"), "one": one})
    rows = rows.withColumn("n", F.greatest(F.lit(4), F.floor(F.col("total") / F.col("step")).cast("int")))
    rows = rows.withColumn("hit", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    late = F.when(F.col("hit") == 0, 0.0).when(F.col("hit") == 1, 0.08 * k).otherwise(0.12 * k)
    rows = rows.withColumn("offset", F.col("step") * (F.col("hit") + late)).where("offset < total")
    slow = F.when(F.col("hit") < 2, 1 + (2 - F.col("hit")) * 0.04 * k).otherwise(1.0)
    length = F.least(F.col("step") * slow, F.col("total") - F.col("offset")) * F.when(F.col("one"), SOUNDS_ONE).otherwise(SOUNDS_TWO)
    arch = 1 - 0.6 * F.pow(2 * F.col("hit") / (F.col("n") - 1) - 1.2, F.lit(2))
    contour = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), arch)) - 0.5) * 2 * k
    pitch = F.when(F.col("hit") % 2 == 0, F.col("pitch")).otherwise(F.col("other"))
    own = {"onset_ms": F.col("onset_ms") + F.col("offset"), "dur_ms": length, "decibels": contour, "velocity": F.floor(F.greatest(F.lit(1), F.least(F.lit(127), F.col("velocity")))).cast("int")}
    return rows.withColumn("pitch", pitch).withColumns(own).drop("step", "total", "one", "n", "offset", "other", "end_ms", "slashes")


def grace_notes(notes: DataFrame, is_grace: Column, length_ms: int = 80) -> DataFrame:
    """A grace note takes its time from the main note after it, which starts later and is shorter.

    ``grace_pitch`` is that of the grace note before a main note (or null), which sounds from the note's own onset for
    ``grace_dur_ms``.
    """
    after = F.coalesce(F.lag(is_grace).over(in_order()), F.lit(False))
    taken = F.when(after, F.least(F.lit(length_ms), F.floor(F.col("dur_ms") / 2))).otherwise(0)
    pitch = F.when(after, F.lag("pitch").over(in_order()))
    return notes.withColumns({"main_onset_ms": F.col("onset_ms") + taken, "main_dur_ms": F.col("dur_ms") - taken, "grace_pitch": pitch, "grace_dur_ms": taken})


def velocity_decibels(velocity: Column, reference: int = 64) -> Column:
    """A velocity as a gain over the reference, in decibels; null for none."""
    return F.when(velocity > 0, 20 * F.log10(velocity / F.lit(float(reference))))


def collapsed(fanned: DataFrame) -> DataFrame:
    """The earliest onset, the number and the largest velocity of the notes made from each source note."""
    return fanned.groupBy("piece_id", "note_idx").agg(F.min("onset_ms").alias("onset_ms"), F.count("*").alias("n"), F.max("velocity").alias("velocity"))


def jitter(notes: DataFrame, seed: int = 0, deviation_ms: float = 5.0) -> DataFrame:
    """Normal jitter shared by equal onsets, drawn from a digest (Box-Muller) and so the same in any partitioning."""
    digest = F.md5(F.concat_ws("|", F.col("piece_id").cast("string"), F.col("onset_ms").cast("string"), F.lit(str(seed))))
    unit = lambda start: (F.conv(F.substring(digest, start, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return notes.withColumn("jitter_ms", deviation_ms * F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(14)))


def pedal_depth(velocity: Column, beat_ms: Column) -> Column:
    raw = 50 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (velocity - 40) / 70)) * F.least(F.lit(1.0), beat_ms / 750) * 60
    return F.greatest(F.lit(40), F.least(F.lit(127), F.floor(raw + 1e-9))).cast("int")


def mapped_times(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Times mapped through (old_ms, new_ms) pairs: linear between the nearest pairs, shifted like the edge outside."""
    both = pairs.select("piece_id", F.col("old_ms").alias("t"), F.struct("old_ms", "new_ms").alias("p"), F.lit(0).alias("side")).unionByName(points.select("piece_id", F.col("at_ms").alias("t"), F.lit(None).cast("struct<old_ms:bigint,new_ms:bigint>").alias("p"), F.lit(1).alias("side")))
    w = Window.partitionBy("piece_id").orderBy("t", "side")
    low, high = F.last("p", ignorenulls=True).over(w), F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"low": low, "high": high}).where("side = 1")
    edge = F.coalesce("low", "high")
    share = F.try_divide(F.col("t") - F.col("low.old_ms"), F.col("high.old_ms") - F.col("low.old_ms"))
    between = F.col("low.new_ms") + share * (F.col("high.new_ms") - F.col("low.new_ms"))
    return rows.select("piece_id", F.col("t").alias("at_ms"), F.coalesce(between, F.col("t") + edge["new_ms"] - edge["old_ms"]).cast("double").alias("mapped_ms"))
