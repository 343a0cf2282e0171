"""Performance effects as columns: each changes loudness in decibels, time in milliseconds or duration by a factor.

Loudness and time add up, durations multiply. Strengths are columns (``k_<effect>``), so that a table of presets or of
drawn settings joins in and one pass makes all versions. A strength of null or 0 leaves an effect out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretables.operators import notes as N


@dataclass(frozen=True)
class Effect:
    """What a note gets of an effect of strength k. ``changes_tempo``: its time is a drift that later notes keep."""

    name: str
    decibels: Callable[[Column], Column] | None = None
    shift_ms: Callable[[Column], Column] | None = None
    factor: Callable[[Column], Column] | None = None
    changes_tempo: bool = False

    def strength(self) -> Column:
        return F.coalesce(F.col(f"k_{self.name}"), F.lit(0.0))


def _arch(p: Column) -> Column:
    """1 at the peak of a phrase (0.6 of it), falling to 0 at both ends."""
    d = F.when(p < 0.6, (0.6 - p) / 0.6).otherwise((p - 0.6) / 0.4)
    return 1 - d * d


def _pull(p: Column) -> Column:
    """How far a phrase runs ahead (below 0) or holds back: rising to the peak, falling after it."""
    return F.when(p < 0.6, -0.1 + 0.2 * p / 0.6).otherwise(0.1 - 0.25 * (p - 0.6) / 0.4)


def _slowness() -> Column:
    """Slow pieces bend more: the square of 100 over the tempo, to 1.5."""
    return F.least(F.lit(1.5), F.pow(100 / F.col("bpm"), 2))


def melodic_charge() -> Column:
    """How little a note belongs to its chord, to 1: motion, dissonances, a weak beat, a short note."""
    score = F.col("motion_score") + F.least(F.lit(0.25), 0.1 * F.coalesce("n_dissonant", F.lit(0))) + F.when(F.col("weak"), 0.2).otherwise(0.0) + F.when(F.col("relative") < 0.5, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), score)


_BEAT, _PLACE, _HAIRPIN = "beat_ms", "phrase_place", "hairpin"

#: The effects, in the order of their names' meaning: loudness, time, articulation. ``hairpin`` is how far a crescendo
#: (or, below 0, a diminuendo) has come; the melody is the highest of the notes that begin together. The strength of
#: ``accent_delay`` is in milliseconds and 0 unless it is asked for.
EFFECTS = (
    Effect("high_loud", decibels=lambda k: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.03 * k * (F.col("pitch") - 60)))),
    Effect("phrase_arch", decibels=lambda k: k * _arch(F.col(_PLACE))),
    Effect("duration_contrast", decibels=lambda k: 0.5 * k * F.log2("relative")),
    Effect("melodic_charge", decibels=lambda k: 2 * k * melodic_charge()),
    Effect("rubato", shift_ms=lambda k: -k * _slowness() * _pull(F.col(_PLACE)) * F.col(_BEAT) / 2),
    Effect("crescendo", decibels=lambda k: 3 * k * F.col(_HAIRPIN), shift_ms=lambda k: -0.1 * k * F.col(_HAIRPIN) * F.col(_BEAT)),
    Effect("punctuation", shift_ms=lambda k: F.when(F.col("starts_phrase"), 20 * k * F.col(_BEAT) / 500).otherwise(0.0), factor=lambda k: F.when(F.col("ends_phrase"), 1 - 0.15 * k).otherwise(1.0), changes_tempo=True),
    Effect("repetition", factor=lambda k: F.when(F.col("repeated"), 1 - 0.1 * k).otherwise(1.0)),
    Effect("staccato", factor=lambda k: F.when(F.col("mark") == "staccato", 1 - 0.25 * k).otherwise(1.0)),
    Effect("legato", factor=lambda k: F.when(F.col("mark") == "legato", 1 + F.least(30 * k, 0.1 * F.col("dur_ms")) / F.col("dur_ms")).otherwise(1.0)),
    Effect("tenuto", decibels=lambda k: F.when(F.col("mark") == "tenuto", k).otherwise(0.0), factor=lambda k: F.when(F.col("mark") == "tenuto", 1 + 0.05 * k).otherwise(1.0)),
    Effect("accent", decibels=lambda k: F.when(F.col("mark") == "accent", 1.5 * k * F.least(F.lit(1.0), F.col("dur_ms") / F.col(_BEAT))).otherwise(0.0)),
    Effect("agogic", shift_ms=lambda k: F.when(F.col("mark").isin("accent", "sforzando"), 20 * k).otherwise(0.0)),
    Effect("accent_delay", shift_ms=lambda k: F.when(F.col("mark") == "accent", k).otherwise(0.0)),
    Effect("articulation_tempo", shift_ms=lambda k: F.when(F.col("mark") == "tenuto", 15 * k).when(F.col("mark") == "legato", 5 * k).otherwise(0.0)),
    Effect("chord_lead", shift_ms=lambda k: F.when(F.col("is_melody"), -25 * k).otherwise(0.0)),
    Effect("fermata", factor=lambda k: F.when(F.col("has_fermata"), 1 + k).otherwise(1.0)),
    Effect("marcato", decibels=lambda k: F.when(F.col("mark") == "marcato", 5 * k).otherwise(0.0), factor=lambda k: F.when(F.col("mark") == "marcato", 1 - 0.05 * k).otherwise(1.0)),
)

# Strengths of the presets that differ from 1.
PRESETS = {
    "romantic": {"high_loud": 1.2, "phrase_arch": 1.3, "duration_contrast": 1.2, "melodic_charge": 1.0, "rubato": 1.3, "crescendo": 1.2, "punctuation": 1.2, "staccato": 1.0, "legato": 1.2},
    "classical": {"high_loud": 0.8, "phrase_arch": 0.8, "duration_contrast": 0.7, "melodic_charge": 0.6, "rubato": 0.7, "crescendo": 0.7, "punctuation": 0.8, "staccato": 1.0, "legato": 0.8},
    "balanced": {},
}
#: Effects that are off where a preset does not name them.
OFF = ("accent_delay",)
#: Settings that are laid beside every note at most; more of them come as a table with a row for each piece.
MOST_SETTINGS = 64


def strength(given: dict[str, float], name: str) -> float:
    return float(given.get(name, 0.0 if name in OFF else 1.0))


def presets(spark: SparkSession) -> DataFrame:
    """``preset`` and the strength of each effect, a row for each preset; what a preset does not name is 1, or 0 if it is in OFF."""
    names = [e.name for e in EFFECTS]
    rows = [(preset, *(strength(given, n) for n in names)) for preset, given in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, " + ", ".join(f"k_{n} double" for n in names))


def prepared(notes: DataFrame, directions: DataFrame, bpm: float = 120.0) -> DataFrame:
    """Notes with all that effects look at; notes need ``mark``, an articulation or null. ``directions`` are crescendos."""
    rows = N.melody(N.melodic_motion(N.phrase_positions(N.features(notes))))
    along = N.active_directions(notes, directions).select("piece_id", "note_idx", F.col("along").alias("hairpin"))
    rows = rows.join(along, ["piece_id", "note_idx"], "left").join(N.sounding_together(notes), ["piece_id", "note_idx"], "left")
    beat = 60_000.0 / bpm
    return rows.withColumns({
        "hairpin": F.coalesce("hairpin", F.lit(0.0)), "bpm": F.lit(bpm), "beat_ms": F.lit(beat), "weak": F.col("onset_ms") % beat != 0,
        "starts_phrase": (F.col("onset_ms") == F.col("phrase_start")) & (F.col("phrase_id") > 0), "ends_phrase": F.col("onset_ms") + F.col("dur_ms") == F.col("phrase_end"),
    })


def applied(rows: DataFrame, strengths: DataFrame, effects: tuple[Effect, ...] = EFFECTS, key: str = "preset") -> DataFrame:
    """For every note and row of ``strengths`` the new ``velocity``, ``shift_ms`` and ``dur_ms``.

    ``strengths`` is a table of settings (``key`` and ``k_<effect>``), as presets() gives it: at most MOST_SETTINGS rows,
    which are laid beside every note. With a column ``piece_id`` it may have any size, and its rows are for the notes of
    that piece. Time of effects that change the tempo is summed up along each piece.
    """
    if "piece_id" in strengths.columns:
        rows = rows.join(strengths, "piece_id")
    else:
        few = strengths.limit(MOST_SETTINGS + 1).collect()
        if len(few) > MOST_SETTINGS:
            raise ValueError(f"more than {MOST_SETTINGS} settings for every note; give the table a piece_id")
        settings = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in r.asDict().items())) for r in few))
        rows = rows.withColumn("setting", F.explode(settings)).select("*", "setting.*")
    total = lambda parts, zero: sum(parts, F.lit(zero))
    decibels = total((e.decibels(e.strength()) for e in effects if e.decibels), 0.0)
    shift = total((e.shift_ms(e.strength()) for e in effects if e.shift_ms and not e.changes_tempo), 0.0)
    drift = total((e.shift_ms(e.strength()) for e in effects if e.shift_ms and e.changes_tempo), 0.0)
    factor = F.lit(1.0)
    for e in effects:
        factor = factor * e.factor(e.strength()) if e.factor else factor
    rows = rows.withColumns({"decibels": decibels, "own_shift": shift, "own_drift": drift, "factor": factor}).withColumn("piece_id", F.struct(key, "piece_id"))
    rows = N.drift(rows, F.col("own_drift")).withColumn("piece_id", F.col("piece_id.piece_id"))
    return rows.select(
        key, "piece_id", "note_idx", N.velocity_after(F.col("velocity"), F.col("decibels")).alias("velocity"), F.col("decibels"),
        (F.col("own_shift") + F.col("drift")).alias("shift_ms"), N.least_duration(F.col("dur_ms") * F.col("factor")).alias("dur_ms"),
    )
