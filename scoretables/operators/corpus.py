"""Corpus plans: splits, versions, manifests, validation, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretables.sources.files import put_aside

# Versions of each split.
VERSIONS = {"train": 4, "valid": 1, "test": 3}


def assigned_splits(stems: DataFrame, names: DataFrame, aliases: Column) -> DataFrame:
    """``split`` of each stem: a stem is in the split that lists it; test comes before valid, train is the rest.

    ``aliases`` turns a listed ``name`` into an array of stems, so that an equi-join replaces a loop over the lists.
    """
    listed = names.select(F.explode(aliases).alias("stem"), F.when(F.col("split") == "test", 0).otherwise(1).alias("rank"))
    best = listed.groupBy("stem").agg(F.min("rank").alias("rank"))
    return stems.join(best, "stem", "left").withColumn("split", F.when(F.col("rank") == 0, "test").when(F.col("rank") == 1, "valid").otherwise("train")).drop("rank")


def name_seed(name: Column) -> Column:
    """A number below 2³² from the name: its md5 modulo 2³²."""
    return F.conv(F.substring(F.md5(name), 25, 8), 16, 10).cast("long")


def version_plan(stems: DataFrame, fonts: list[str], versions: dict[str, int] = VERSIONS) -> DataFrame:
    """A row for each version of a stem: its key, font, whether it is transposed, and its seed."""
    n = F.lit(1)
    for split, count in versions.items():
        n = F.when(F.col("split") == split, count).otherwise(n)
    rows = stems.withColumn("version", F.explode(F.sequence(F.lit(0), n - 1)))
    font = F.element_at(F.array(*(F.lit(x) for x in fonts)), F.when(F.col("split") == "valid", 1).otherwise(F.col("version") % len(fonts) + 1))
    short = F.substring(font, F.lit(1), F.length(font) - 4)
    key = F.when(F.col("split") == "train", F.concat(F.col("stem"), F.lit("_v"), F.col("version").cast("string"), F.lit("~"), short)).otherwise(F.concat(F.col("stem"), F.lit("~"), short))
    return rows.withColumns({"soundfont": font, "id": key, "transposed": (F.col("split") == "train") & (F.col("version") > 0), "seed": name_seed(key)})


def validated(manifest: DataFrame, audio: DataFrame, scores: DataFrame) -> DataFrame:
    """Each row's ``problem``: no audio, else no score, else null; two joins against what exists."""
    a = audio.select("stem", F.lit(True).alias("has_audio")).distinct()
    s = scores.select("doc_id", F.lit(True).alias("has_score")).distinct()
    problem = F.when(F.col("has_audio").isNull(), "missing_audio").when(F.col("has_score").isNull(), "missing_score")
    return manifest.join(a, "stem", "left").join(s, "doc_id", "left").withColumn("problem", problem).drop("has_audio", "has_score")


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Count, total, mean, least and most of the durations; zeros for an empty table."""
    zero = F.lit(0.0)
    return manifest.agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("duration_sec"), zero), 6).alias("total_sec"), F.round(F.coalesce(F.avg("duration_sec"), zero), 6).alias("mean_sec"),
        F.coalesce(F.min("duration_sec"), zero).alias("least_sec"), F.coalesce(F.max("duration_sec"), zero).alias("most_sec"), F.coalesce(F.sum("n_frames"), F.lit(0)).alias("frames"),
    )


def plan_summary(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """Versions of each split, transposed ones, and measures summed over distinct documents."""
    counts = plan.groupBy("split").agg(F.count("*").alias("n"), F.count_if("transposed").alias("n_transposed"))
    distinct = plan.select("split", "doc_id").distinct().join(sizes, "doc_id").groupBy("split").agg(F.sum("n_measures").alias("n_measures"))
    return counts.join(distinct, "split", "left")


def durations(manifest: DataFrame, rate: int = 16_000, hop: int = 160) -> DataFrame:
    """``duration`` or, where it is null, frames over the frame rate, and frames of that duration."""
    seconds = F.round(F.coalesce("duration_sec", F.col("n_frames") * hop / rate), 4)
    return manifest.withColumn("seconds", seconds).withColumn("frames", F.floor(F.col("seconds") * rate / hop))


def outcomes(rows: DataFrame, status: str) -> DataFrame:
    """Outcome counts by the start of the status."""
    s = F.col(status)
    return rows.agg(F.count("*").alias("n"), F.count_if(s == "ok").alias("n_ok"), F.count_if(s.startswith("error:")).alias("n_error"), F.count_if(s.startswith("skipped")).alias("n_skipped"))


def first_existing(files: DataFrame, names: list[str]) -> DataFrame:
    """Of each folder the file whose name comes first in ``names``; among equals the first path."""
    rank = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("name"))
    return files.withColumn("rank", rank).where("rank > 0").groupBy("folder").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def listed_scan(files: DataFrame, names: DataFrame, reserved: DataFrame, piece: str, key: str) -> DataFrame:
    """The files of the listed pieces, without reserved ones."""
    return files.join(names.select(piece).distinct(), piece, "left_semi").join(reserved.select(key).distinct(), key, "left_anti")


def nested_scan(files: DataFrame, names: list[str]) -> DataFrame:
    """Of each piece folder (``top/piece``) the first file by ``names``; where a piece has none itself, that of each of its
    folders (``top/piece/part``). ``files``: ``top``, ``piece``, ``part`` (or null), ``name``, ``path``."""
    rank = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("name"))
    rows = files.withColumn("rank", rank).where("rank > 0")
    best = rows.groupBy("top", "piece", "part").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    own = best.where("part is null").select("top", "piece")
    return best.where("part is null").unionByName(best.where("part is not null").join(own, ["top", "piece"], "left_anti").select(best.columns))


def ranked_lookup(wanted: DataFrame, files: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """The file of each wanted row by the first rule that finds one, ties by path.

    A rule is a pair of equal keys; a file may have several (an array), such as all its prefixes or parts, so that a
    search by pattern is a join too.
    """
    found = None
    for i, (mine, theirs) in enumerate(rules):
        keyed = files.select(theirs.alias("rule_key"), "path")
        if keyed.schema["rule_key"].dataType.typeName() == "array":
            keyed = keyed.select(F.explode(F.array_distinct("rule_key")).alias("rule_key"), "path")
        # One file a key is enough, so that no key pairs all its files with all that want it.
        keyed = keyed.groupBy("rule_key").agg(F.min("path").alias("path"))
        one = wanted.withColumn("rule_key", mine).join(keyed, "rule_key").select("wanted", F.struct(F.lit(i).alias("rule"), "path").alias("hit"))
        found = one if found is None else found.unionByName(one)
    return wanted.join(found.groupBy("wanted").agg(F.min("hit").alias("hit")), "wanted", "left").select("wanted", "hit.rule", "hit.path")


#: Letters of the grams by which a search finds the paths that may hold a text.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def containing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each wanted text (not empty) the first path that contains it, or null.

    An inverted index of grams: only grams of wanted texts are kept, the rarest of each text is joined, and what it finds
    is compared whole. Texts shorter than a gram are grams themselves.
    """
    texts = wanted.select("wanted").distinct().where("wanted <> ''")
    size = F.least(F.lit(GRAM), F.length("wanted"))
    asked = texts.select("wanted", F.explode(_grams(F.col("wanted"), size)).alias("gram"))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("path"))), lambda n: _grams(F.col("path"), n)))
    index = put_aside(files.select("path").distinct().select("path", F.explode(every).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no path has makes a text that none contains.
    rare = asked.join(sizes, "gram", "left").groupBy("wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = rare.join(index, "gram").where(F.contains("path", "wanted")).groupBy("wanted").agg(F.min("path").alias("path"))
    return wanted.join(hits, "wanted", "left")


def prefixes(name: Column, sep: str = "_") -> Column:
    """Every start of a name that ends at a separator or with the name."""
    parts = F.split(name, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def among(rows: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in the one set (if given) and not in the other."""
    rows = rows if include is None else rows.join(include.select(key).distinct(), key, "left_semi")
    return rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")


def first_of_each(rows: DataFrame, order: str, *keys: Column) -> DataFrame:
    """Of rows with equal keys the one that comes first, whole; a minimum, so that no group is gathered."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    first = rows.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("first"))
    return first.select("first.*")


def renamed(name: Column, prefix: str, suffix: str = "", old: str = " ", new: str = "_") -> Column:
    """A file name in another corpus: prefix, name with one mark for another, suffix."""
    return F.concat(F.lit(prefix), F.replace(name, F.lit(old), F.lit(new)), F.lit(suffix))


def missing_log(validated_rows: DataFrame) -> DataFrame:
    """How many rows have each problem, with the first and last of their names."""
    return validated_rows.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"), F.min("stem").alias("first_stem"), F.max("stem").alias("last_stem"))


def split_points(ids: DataFrame, column: str, sep: str = "_") -> DataFrame:
    """Every way to cut an id at a separator: ``left`` and ``right`` of cut ``j``."""
    parts = F.split(F.col(column), sep)
    rows = ids.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1))))
    return rows.where("size(parts) > 1").withColumns({"left": F.array_join(F.slice("parts", F.lit(1), F.col("j")), sep), "right": F.array_join(F.slice("parts", F.col("j") + 1, F.size("parts")), sep)}).drop("parts")


def listed(lines: DataFrame) -> DataFrame:
    """Names of a list: blanks, comments and the heading are left out, the ending is cut off."""
    name = F.trim("value")
    return lines.select(F.regexp_replace(name, r"\.krn$", "").alias("name")).where("name <> '' and name not like '#%' and name <> 'name'")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, the same in any partitioning: those of the smallest digests of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def last_measure_inherited(rows: DataFrame) -> DataFrame:
    """Original measure of each expanded one; where it is null the last one before it holds."""
    order = Window.partitionBy("doc_id").orderBy("expanded")
    return rows.withColumn("original", F.last("original", ignorenulls=True).over(order))
