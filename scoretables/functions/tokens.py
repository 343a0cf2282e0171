"""Scalar functions of score tokens, as Column expressions."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that layout, beams and articulation add to a token.
LAYOUT = r"[/\\XyzN*=?]"
ARTICULATION = r"[TMSmstpP'~^><;:`Oxvuw&@ijZ+W$!|]"
BEAMS = "[LJkK]"
#: Where a note ends and another, with a duration of its own, begins without a blank.
JOINT, PITCHED = r"(?<=[A-Ga-gr#\-n])(?=[0-9])", "[A-Ga-gr]"
#: A rest's position, a natural after a letter, and pairs of accidentals that contradict each other.
REST_POSITION = r"([0-9]+\.*r)[A-Ga-gy]+"
NATURAL = "([A-Ga-g])n(?=[^A-Ga-g]|$)"
NATURAL_SHARP, NATURAL_FLAT = "n#|#n", "n-|-n"
#: A duration after opening marks, one written with a ratio, a clef with editorial marks, the order of sections.
DURATION, RATIO, CLEF, SECTIONS = r"^[\[({]*([0-9]+\.?)", "[0-9]+%[0-9]+", r"([FGC][0-9])[xy]+$", r"\*>\[([^\]]+)\]"
#: Comments about what is shown only; a cue's opening marks and its length.
SHOWN, CUE_OPENING, CUE_LENGTH = (":vis=", ":stem="), r"^[\[({<>]+", r"^([0-9]+\.?(?:%[0-9]+)?)"
#: Semitones of each letter.
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
#: Double accidentals and their plain equals: letters first, then the accidental that is left.
DOUBLE_SHARP = {"C": "D", "D": "E", "E": "F#", "F": "G", "G": "A", "A": "B", "B": "C#"}
DOUBLE_FLAT = {"C": "B-", "D": "C", "E": "D", "F": "E-", "G": "F", "A": "G", "B": "A"}
#: Dotted triplets and the plain duration each equals.
DOTTED_TRIPLETS = {"96.": "64", "48.": "32", "24.": "16", "12.": "8", "6.": "4", "3.": "2"}
#: Rest tokens by length in 64ths of a quarter note, longest first.
RESTS = ((256, "1r"), (192, "2.r"), (128, "2r"), (96, "4.r"), (64, "4r"), (48, "8.r"), (32, "8r"), (24, "16.r"), (16, "16r"), (12, "32.r"), (8, "32r"), (6, "64.r"), (4, "64r"), (2, "128r"), (1, "256r"))
TEMPO_NAMES = (("larghissimo", 20), ("grave", 35), ("largo", 50), ("lento", 52), ("larghetto", 63), ("adagio", 71), ("andantino", 94), ("andante", 92), ("moderato", 114), ("allegretto", 116), ("allegro", 138), ("vivace", 166), ("presto", 184))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value of a key, or null; a chain of comparisons that stays in generated code."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def is_control(token: Column) -> Column:
    return token.rlike("^[=*!]")


def clean(token: Column, ties: bool = True, articulation: bool = False) -> Column:
    """A note token with its musical content only; control tokens as they are. Chords are given note by note."""
    c = F.regexp_replace(token, r"^(\[?)(96|48|24|12|6|3)\.(?![0-9])", "$1<$2>")
    for dotted, plain in DOTTED_TRIPLETS.items():
        c = F.replace(c, F.lit(f"<{dotted[:-1]}>"), F.lit(plain))
    c = F.regexp_replace(c, REST_POSITION, "$1")
    c = F.regexp_replace(c, LAYOUT, "")
    c = F.regexp_replace(F.regexp_replace(c, NATURAL_SHARP, "#"), NATURAL_FLAT, "-")
    c = F.replace(c, F.lit("nn"), F.lit("n"))
    if not articulation:
        c = F.regexp_replace(c, ARTICULATION, "")
    c = F.regexp_replace(c, BEAMS, "")
    if not ties:
        c = F.regexp_replace(c, r"[\[\]_]", "")
    return F.when(is_control(token), clean_control(token)).otherwise(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def clean_line(line: Column, ties: bool = True, articulation: bool = False) -> Column:
    """A score line with every field cleaned, chords note by note."""
    field = lambda x: F.when(is_control(x), clean(x, ties, articulation)).otherwise(F.array_join(F.transform(F.split(x, " "), lambda n: clean(n, ties, articulation)), " "))
    return F.array_join(F.transform(F.split(line, "\t"), field), "\t")


def layout(token: Column) -> Column:
    """Stem, beams and placement of a token as a struct."""
    return F.struct(
        F.when(token.contains("/"), "up").when(token.contains("\\"), "down").alias("stem"),
        F.length(F.regexp_replace(token, "[^L]", "")).alias("beams_open"),
        F.length(F.regexp_replace(token, "[^J]", "")).alias("beams_close"),
        F.when(token.contains(">"), "above").when(token.contains("<"), "below").alias("placement"),
    )


def is_dirty(token: Column) -> Column:
    """Whether a token is neither ignored nor of the clean form."""
    return ~token.isin("", ".", "q") & ~token.rlike(r"^[0-9.]+[rA-Ga-g#\-n_\[\]]+$")


def dirt(token: Column) -> Column:
    """The first category that a dirty token falls into."""
    return F.when(token.rlike("r[A-Ga-g]+"), "rest position").when(token.rlike(r"[/\\]"), "stem").when(token.rlike(r"[';~^:`]"), "articulation").otherwise("other")


def rational(token: Column) -> Column:
    """A token's duration in quarter notes as struct (num, den); grace notes are 0, no number is null.

    Plain values are 4 / n; "0" is a breve (8) and "00" 16; d dots multiply by 2 - 2^-d.
    """
    digits = F.regexp_extract(token, r"([0-9]+)", 1)
    dots = F.length(F.regexp_extract(token, r"[0-9]+(\.*)", 1))
    n = digits.try_cast("long")
    num = F.when(digits == "0", 8).when(digits == "00", 16).otherwise(4).cast("long")
    den = F.when(digits.isin("0", "00"), 1).otherwise(n)
    up = F.pow(F.lit(2), dots).cast("long")
    dotted = F.struct((num * (2 * up - 1)).alias("num"), (den * up).alias("den"))
    return F.when(token.rlike("[qQ]"), F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))).when(digits != "", dotted)


def rests(ticks: Column) -> Column:
    """Rest tokens that fill a length in 64ths of a quarter, longest first; a fold over the fixed table."""
    names = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(r).alias("r")) for n, r in RESTS))
    start = F.struct(ticks.cast("long").alias("left"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.struct((acc["left"] % x["n"]).alias("left"), F.concat(acc["out"], F.array_repeat(x["r"], F.floor(acc["left"] / x["n"]).cast("int"))).alias("out"))
    return F.array_join(F.aggregate(names, start, step, lambda acc: acc["out"]), " ")


def midi(pitch: Column) -> Column:
    """MIDI number of letters with accidentals; -1 for rests and anything else."""
    letters = F.regexp_extract(pitch, r"^([A-G]+|[a-g]+)([#\-]*)$", 1)
    accidentals = F.regexp_extract(pitch, r"^([A-G]+|[a-g]+)([#\-]*)$", 2)
    letter = F.upper(F.substring(letters, 1, 1))
    base = F.lit(None).cast("int")
    for k, v in SEMITONES.items():
        base = F.when(letter == k, v).otherwise(base)
    octave = F.when(letters.rlike("^[A-G]"), 5 - F.length(letters)).otherwise(4 + F.length(letters))
    sharps = F.length(F.replace(accidentals, F.lit("-"), F.lit(""))) - F.length(F.replace(accidentals, F.lit("#"), F.lit("")))
    return F.coalesce(octave * 12 + base + sharps, F.lit(-1))


def strip_naturals(token: Column) -> Column:
    return F.regexp_replace(token, NATURAL, "$1")


def respelled(pitch: Column) -> Column:
    """Letters with a double accidental as their plain equal, in the same octave's letters; others as they are."""
    letters = F.regexp_extract(pitch, r"^([A-Ga-g]+)(##|--)$", 1)
    first = F.upper(F.substring(letters, 1, 1))
    same = F.when(pitch.endswith("##"), lookup(first, DOUBLE_SHARP)).otherwise(lookup(first, DOUBLE_FLAT))
    head = F.repeat(F.substring(same, 1, 1), F.length(letters))
    head = F.when(letters.rlike("^[a-g]"), F.lower(head)).otherwise(head)
    return F.when(letters != "", F.concat(head, F.substring(same, 2, 1))).otherwise(pitch)


def within_range(pitch: Column, low: int = 21, high: int = 108) -> Column:
    """The MIDI number of a pitch, moved by octaves into the range of the keyboard; -1 for rests and anything else."""
    n = midi(pitch)
    up, down = F.ceil((low - n) / 12) * 12, F.ceil((n - high) / 12) * 12
    return F.when(n < 0, n).when(n < low, n + up).when(n > high, n - down).otherwise(n).cast("int")


def strip_slurs(token: Column) -> Column:
    return F.regexp_replace(token, "[(){}&]", "")


def factors(token: Column) -> Column:
    """The parts of a note token: opening ties, duration, grace mark, pitch, (duration, pitch)*, closing ties.

    A duration without a pitch is a rest; "." stands for itself; an empty array means that nothing was recognised.
    """
    opening = F.regexp_extract(token, r"^([\[({]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(token, r"^[\[({]+", ""), "[LJKk]+$", "")
    grace = F.regexp_extract(rest, "([qQP])", 1)
    rest = F.regexp_replace(rest, "[qQP]", "")
    found = F.regexp_extract_all(rest, F.lit(r"(([A-G])\2*|([a-g])\3*)[#\-n]*|r"), F.lit(0))
    clear = lambda p: F.when(p.rlike("^[^-]*#.*-"), F.replace(p, F.lit("-"), F.lit(""))).when(p.rlike("^[^#]*-.*#"), F.replace(p, F.lit("#"), F.lit(""))).otherwise(p)
    pitches = F.filter(F.transform(found, lambda p: clear(F.when(p == "r", p).otherwise(F.replace(p, F.lit("n"), F.lit(""))))), lambda p: p != "")
    duration = F.regexp_extract(rest, r"([0-9]+\.?)", 1)
    closing = F.regexp_extract(rest, r"([\])}]+)$", 1)
    letters = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    timed = F.flatten(F.transform(pitches, lambda p, i: F.filter(F.array(duration, F.when(i == 0, grace).otherwise(""), p), lambda x: x != "")))
    bare = F.when((F.size(pitches) == 0) & (duration != ""), F.array(duration, F.lit("r"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(token, F.lit("")).isin("", "."), F.array(F.lit("."))).otherwise(F.concat(letters(opening), timed, bare, letters(closing)))


def split_notes(token: Column) -> Column:
    """Notes that are written without a blank between them, each with its duration; numbers without a pitch fall out."""
    clear = F.regexp_replace(token, BEAMS, "")
    notes = F.filter(F.split(clear, JOINT), lambda x: x.rlike(PITCHED))
    return F.when(F.size(notes) > 0, notes).otherwise(F.array(clear))


#: The end as Java's "$" has it, also before a last line terminator.
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_OPENING, _CLOSING, _LAST_BEAMS = re.compile(r"[\[({]+"), re.compile(r"[\])}]+" + _END), re.compile("[LJKk]+" + _END)
_GRACE, _NUMBER, _PITCH = re.compile("[qQP]"), re.compile(r"[0-9]+\.?"), re.compile(r"(?:([A-G])\1*|([a-g])\2*)[#\-n]*|r")
_BEAMS, _JOINT, _PITCHED = re.compile(BEAMS), re.compile(JOINT), re.compile(PITCHED)
_SHARP_FLAT, _FLAT_SHARP = re.compile("[^-]*#.*-"), re.compile("[^#]*-.*#")
#: Distinct fields whose tokens a task remembers.
_REMEMBERED = 1 << 15


def _factors(token: str) -> list[str]:
    """The same as ``factors``, of a string."""
    if token in ("", "."):
        return ["."]
    opening = _OPENING.match(token)
    opening = opening[0] if opening else ""
    rest = _LAST_BEAMS.sub("", token[len(opening) :])
    grace = _GRACE.search(rest)
    rest = _GRACE.sub("", rest)
    pitches = []
    for found in _PITCH.finditer(rest):
        p = found[0].replace("n", "")
        p = p.replace("-", "") if _SHARP_FLAT.match(p) else p.replace("#", "") if _FLAT_SHARP.match(p) else p
        pitches.append(p)
    duration, closing = _NUMBER.search(rest), _CLOSING.search(rest)
    duration = [duration[0]] if duration else []
    out = list(opening)
    for i, p in enumerate(pitches):
        out += [*duration, grace[0], p] if grace and i == 0 else [*duration, p]
    if duration and not pitches:
        out += [*duration, "r"]
    return out + list(closing[0] if closing else "")


def _split_notes(token: str) -> list[str]:
    """The same as ``split_notes``, of a string."""
    clear = _BEAMS.sub("", token)
    return [x for x in _JOINT.split(clear) if _PITCHED.search(x)] or [clear]


@functools.lru_cache(_REMEMBERED)
def _field_tokens(field: str) -> str:
    return " ".join(x for chord_note in field.split(" ") if chord_note for note in _split_notes(chord_note) for x in _factors(note))


@functools.lru_cache(_REMEMBERED)
def _next_field_tokens(field: str) -> str:
    return f" <coc> {_field_tokens(field)}".rstrip(" ")


def _line_tokens(line: str) -> str:
    first, *others = line.split("\t")
    return (_field_tokens(first) + "".join(map(_next_field_tokens, others))).lstrip(" ")


def _lines_tokens(lines: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _line_tokens(x) for x in lines.to_pylist()], pa.string())


def line_tokens(line: Column) -> Column:
    """The factors of all notes of a score line's fields, with ``<coc>`` between fields and a blank between tokens.

    Fields repeat, and a field is taken apart once for as long as it is remembered: as expressions inside expressions the
    factors of a note are evaluated over and over.
    """
    return F.arrow_udf(_lines_tokens, "string")(line)


def plain_barline(line: Column) -> Column:
    """A barline's fields without repeat marks; other lines as they are."""
    fields = F.transform(F.split(line, "\t"), lambda x: F.when(x.startswith("="), F.regexp_replace(x, r"[:|!]+", "")).otherwise(x))
    return F.when(line.startswith("="), F.array_join(fields, "\t")).otherwise(line)


def expansion_order(text: Column) -> Column:
    """Section names in playback order, or null."""
    inside = F.regexp_extract(text, SECTIONS, 1)
    return F.when(inside != "", F.transform(F.split(inside, ","), lambda x: F.trim(x)))


def key_name(signature: Column) -> Column:
    """A key signature ``*k[...]`` with its sharps and flats only: naturals and anything else inside fall out."""
    marks = F.regexp_extract_all(F.regexp_extract(signature, r"^\*k\[(.*)\]$", 1), F.lit("[a-g][#-]"), F.lit(0))
    return F.concat(F.lit("*k["), F.array_join(marks, ""), F.lit("]"))


def cue_rest(token: Column) -> Column:
    """A cue note as a rest of its duration (of a chord its first note's); grace notes as grace rests."""
    first = F.regexp_replace(F.get(F.split(token, " +"), F.lit(0)), CUE_OPENING, "")
    duration = F.regexp_extract(first, CUE_LENGTH, 1)
    after = F.substr(first, F.length(duration) + 1)
    rest = F.concat(duration, F.when(F.lower(after).contains("q"), F.lit("qr")).otherwise(F.lit("r")))
    return F.when(F.coalesce(token, F.lit("")).isin("", ".") | (duration == ""), token).otherwise(rest)


def clean_control(token: Column) -> Column:
    """Clefs without editorial marks; comments on visible length or stem direction emptied; other tokens as they are."""
    clef = F.regexp_replace(token, CLEF, "$1")
    hint = token.startswith("!") & (token.contains(SHOWN[0]) | token.contains(SHOWN[1]))
    return F.when(hint, "!").when(token.startswith("*clef"), clef).otherwise(token)


def tempo(text: Column, default: int = 120) -> Column:
    """Beats a minute of a marking: the number after "=", else a number from 20 to 300, else by name, else the default."""
    equal = F.regexp_extract(text, r"=\s*([0-9]+)", 1).try_cast("int")
    number = F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")
    named = F.lit(default)
    for name, bpm in reversed(TEMPO_NAMES):
        named = F.when(F.lower(text).contains(name), bpm).otherwise(named)
    return F.coalesce(equal, F.when(number.between(20, 300), number), named)


def nearest_power(n: Column) -> Column:
    """The power of two (1 to 128) whose length 1 / p is nearest to 1 / n; of two as near the longer."""
    low = F.least(F.lit(7), F.floor(F.log2(n) + 1e-12)).cast("int")
    high = F.least(F.lit(7), F.ceil(F.log2(n) - 1e-12)).cast("int")
    p, q = F.pow(F.lit(2), low).cast("long"), F.pow(F.lit(2), high).cast("long")
    # |1/p - 1/n| <= |1/n - 1/q|, in whole numbers.
    return F.when(F.abs(n - p) * q <= F.abs(q - n) * p, p).otherwise(q)
