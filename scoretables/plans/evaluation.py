"""Evaluation analytics over the results table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoretables.operators import bands, ids, summaries, transition
from scoretables.plans.registry import Family

query = Family()
M = summaries.METRICS
OK = "status = 'success'"
CUSTOM = "(multi_pitch + voice + value + harmony) / 4"


def _each(text: str) -> str:
    return ", ".join(text.replace("{m}", m) for m in M)


#: The overall summary, also of results that took other ways.
OVERALL = f"""SELECT system, count(*) AS n_total, count(*) FILTER (WHERE {OK}) AS n_success, round(count(*) FILTER (WHERE {OK}) / count(*), 9) AS success_rate,
    {_each("round(avg({m}) FILTER (WHERE status = 'success'), 9) AS {m}_mean")}, {_each("round(coalesce(sum({m}) FILTER (WHERE status = 'success'), 0) / count(*), 9) AS {m}_strict")}
    FROM results GROUP BY system"""


@query("results", sql=OVERALL)
def overall_summary(results):
    return summaries.overall(results)


@query("results", sql=f"""SELECT r.system, count(*) AS n_scored, count(*) FILTER (WHERE {OK}) AS n_success, any_value(d.n) AS n_defined, round(count(*) FILTER (WHERE {OK}) / count(*), 9) AS success_rate,
    {_each("round(coalesce(avg({m}) FILTER (WHERE status = 'success'), 0), 9) AS {m}_mean")}, {_each("round(coalesce(sum({m}) FILTER (WHERE status = 'success'), 0) / any_value(d.n), 9) AS {m}_strict")}
    FROM results r CROSS JOIN (SELECT count(DISTINCT task_id) AS n FROM results) d GROUP BY r.system""")  # fmt: skip
def chunk_summary_external_total(results):
    return summaries.against_defined(results, results.select("task_id").distinct())


@query("results", sql=f"SELECT system, count(*) AS n, round(avg({CUSTOM}), 9) AS mean_custom, round(avg((multi_pitch + voice + meter + value + harmony) / 5), 9) AS mean_official, {_each('round(avg({m}), 9) AS mean_{m}')} FROM results WHERE {OK} GROUP BY system")
def plain_metric_means(results):
    return summaries.plain_means(results.where(summaries.succeeded()), "system")


@query("results", sql=f"SELECT piece_id, performance, count(*) AS n, round(avg({CUSTOM}), 9) AS mean_custom, round(avg((multi_pitch + voice + meter + value + harmony) / 5), 9) AS mean_official, {_each('round(avg({m}), 9) AS mean_{m}')} FROM results WHERE {OK} AND system = 'sys1' GROUP BY ALL")
def full_song_summary(results):
    return summaries.plain_means(results.where(summaries.succeeded() & (F.col("system") == "sys1")), "piece_id", "performance")


@query("results", sql="SELECT system, status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY system), 9) AS percent FROM results GROUP BY system, status")
def status_histogram(results):
    return summaries.status_shares(results)


_BIN = "CASE " + " ".join(f"WHEN chunk_index BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in summaries.BINS) + " END"


@query("results", sql=f"""SELECT system, {_BIN} AS bin, count(*) AS n, count(*) FILTER (WHERE {OK}) AS n_success, round(count(*) FILTER (WHERE {OK}) / count(*), 9) AS success_rate,
    {_each("round(avg({m}) FILTER (WHERE status = 'success'), 9) AS {m}_mean")} FROM results WHERE {_BIN} IS NOT NULL GROUP BY ALL""")  # fmt: skip
def metrics_by_position(results):
    return summaries.position_bins(results)


@query("results", sql=f"""SELECT system, count(*) AS n_total, count(*) FILTER (WHERE {OK}) AS n_success, round(count(*) FILTER (WHERE {OK}) / count(*), 9) AS success_rate,
    {_each("round(avg({m}) FILTER (WHERE status = 'success'), 9) AS {m}_mean")}, {_each("round(coalesce(sum({m}) FILTER (WHERE status = 'success'), 0) / count(*), 9) AS {m}_strict")}
    FROM results WHERE task_id IN (SELECT task_id FROM results WHERE system = 'sys2') GROUP BY system""")  # fmt: skip
def fair_comparison(results):
    return summaries.overall(summaries.fair_subset(results, "sys2"))


@query("results", sql="SELECT system, status, count(*) AS n, round(avg(chunk_index), 9) AS mean_index, quantile_cont(chunk_index, 0.5) AS median_index FROM results GROUP BY ALL")
def failure_index_stats(results):
    return summaries.index_by_status(results)


@query("results", sql=f"SELECT task_id, chunk_index FROM results WHERE system = 'sys0' AND task_id NOT IN (SELECT task_id FROM results WHERE system = 'sys2' AND {OK})")
def resume_remaining_tasks(results):
    return summaries.remaining(results.where("system = 'sys0'").select("task_id", "chunk_index"), results.where("system = 'sys2'"))


@query("results", sql="SELECT task_id, status, multi_pitch FROM results WHERE system = 'sys2' UNION ALL SELECT task_id, 'no_ground_truth', NULL FROM results WHERE system = 'sys0' AND task_id NOT IN (SELECT task_id FROM results WHERE system = 'sys2')")
def results_with_skipped(results):
    tasks = results.where("system = 'sys0'").select("task_id")
    return summaries.with_missing(results.where("system = 'sys2'").select("task_id", "status", "multi_pitch"), tasks, "no_ground_truth")


@query("results", sql=f"""SELECT * FROM (WITH latest AS (SELECT * FROM results WHERE system = 'sys0' AND {OK} UNION ALL SELECT 'sys0' AS system, * EXCLUDE (system) FROM results WHERE system = 'sys1' AND task_id NOT IN (SELECT task_id FROM results WHERE system = 'sys0' AND {OK}))
    SELECT system, status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY system), 9) AS percent FROM latest GROUP BY system, status)""")  # fmt: skip
def retried_results_latest(results):
    """Failures of one run are tried again in another; the later row of a task counts."""
    old = results.where("system = 'sys0'")
    retried = summaries.remaining(results.where("system = 'sys1'"), old).withColumn("system", F.lit("sys0"))
    return summaries.status_shares(summaries.latest(old, retried))


@query("results", sql="SELECT system, count(*) FILTER (WHERE status = 'timeout') AS n_timeout, count(*) FILTER (WHERE status NOT IN ('timeout', 'success')) AS n_error FROM results GROUP BY system")
def failure_sinks(results):
    return summaries.failures(results)


@query("results", sql="SELECT system, task_id, status FROM results WHERE status IN ('timeout', 'mv2h_failed')")
def retry_list(results):
    return results.where(F.col("status").isin("timeout", "mv2h_failed")).select("system", "task_id", "status")


@query("results", sql="SELECT DISTINCT task_id, piece_id AS p_piece, performance AS p_performance, chunk_index::INTEGER AS p_index FROM results")
def parsed_task_ids(results):
    parsed = ids.parse_chunk_id(F.col("task_id"))
    return results.select("task_id", parsed["piece_id"].alias("p_piece"), parsed["performance"].alias("p_performance"), parsed["chunk_index"].alias("p_index")).distinct()


@query("results", sql="SELECT DISTINCT task_id, regexp_replace(task_id, '\\.[^.]*$', '') AS song, concat(piece_id, '#', performance) AS pair, concat(replace(piece_id, '#', '__'), '__', performance) AS entry FROM results")
def song_ids(results):
    return results.select("task_id", ids.song_of_task(F.col("task_id")).alias("song"), F.concat_ws("#", "piece_id", "performance").alias("pair"), ids.entry_id(F.col("piece_id"), F.col("performance")).alias("entry")).distinct()


_RAW = """(SELECT system, task_id, CASE WHEN chunk_index % 3 = 0 THEN NULL ELSE performance END AS performance, CASE WHEN chunk_index % 4 = 0 THEN '' ELSE CAST(chunk_index AS VARCHAR) END AS chunk_index,
    CASE WHEN chunk_index % 5 = 0 THEN 'n/a' ELSE CAST(multi_pitch AS VARCHAR) END AS multi_pitch FROM results)"""


@query("results", sql=f"""SELECT system, task_id, coalesce(performance, regexp_extract(task_id, '#([^#.]*)\\.[^.]*$', 1)) AS performance,
    CASE WHEN coalesce(TRY_CAST(chunk_index AS INTEGER), 0) = 0 THEN CAST(regexp_extract(task_id, '\\.([0-9]+)$', 1) AS INTEGER) ELSE CAST(chunk_index AS INTEGER) END AS chunk_index,
    coalesce(TRY_CAST(multi_pitch AS DOUBLE), 0) AS multi_pitch FROM {_RAW}""")  # fmt: skip
def repaired_results(results):
    """Strings with gaps, as a results file has them, made whole from the task ids."""
    raw = results.select(
        "system", "task_id", F.when(F.col("chunk_index") % 3 != 0, F.col("performance")).alias("performance"), F.when(F.col("chunk_index") % 4 == 0, "").otherwise(F.col("chunk_index").cast("string")).alias("chunk_index"),
        F.when(F.col("chunk_index") % 5 == 0, "n/a").otherwise(F.col("multi_pitch").cast("string")).alias("multi_pitch"),
    )
    return ids.repair_results(raw, ("multi_pitch",))


@query("results", sql=f"""SELECT system, task_id, CASE WHEN chunk_index % 11 = 0 THEN 'error' WHEN chunk_index % 7 = 0 THEN 'mv2h_failed'
    WHEN multi_pitch * (chunk_index % 2) = 0 AND (multi_pitch + voice + meter + value + harmony) * (chunk_index % 2) / 5 = 0 THEN 'zero_score' ELSE 'success' END AS judged, round({CUSTOM}, 9) AS custom FROM results""")  # fmt: skip
def status_taxonomy(results):
    scaled = F.struct(*((F.col(m) * (F.col("chunk_index") % 2)).alias(m) for m in M))
    metrics = F.when(F.col("chunk_index") % 7 != 0, scaled)
    error = F.when(F.col("chunk_index") % 11 == 0, F.lit("boom"))
    return results.select("system", "task_id", summaries.status_of(metrics, error).alias("judged"), F.round(summaries.custom_mean(), 9).alias("custom"))


@query("results", sql="SELECT piece_id, performance, count(*) AS n_chunks, array_to_string(list_sort(list(chunk_index)), ',') AS indexes FROM results WHERE system = 'sys2' GROUP BY ALL")
def chunks_by_performance(results):
    found = summaries.grouped_chunks(results.where("system = 'sys2'"))
    return found.withColumn("indexes", F.array_join(F.col("indexes").cast("array<string>"), ","))


@query("results", sql="""SELECT system, task_id, success, previous, round(chunk_index / (most + 1), 9) AS position, CASE WHEN most > 0 THEN round(chunk_index / most, 9) END AS plot_position FROM (
    SELECT *, (status = 'success')::INTEGER AS success, lag((status = 'success')::INTEGER) OVER w AS previous, max(chunk_index) OVER (PARTITION BY system, piece_id, performance) AS most
    FROM results WINDOW w AS (PARTITION BY system, piece_id, performance ORDER BY chunk_index)) WHERE previous IS NOT NULL""")  # fmt: skip
def lagged_outcomes(results):
    rows = transition.lagged(results, "piece_id", "performance")
    return rows.select("system", "task_id", "success", "previous", F.round("position", 9).alias("position"), F.round("plot_position", 9).alias("plot_position"))


@query("results", sql=f"""SELECT system, piece_id, performance, measure, count(*) AS n_chunks, round(avg(({OK})::INTEGER), 9) AS success_rate
    FROM (SELECT *, unnest(range(chunk_index, chunk_index + 5)) AS measure FROM results) GROUP BY ALL""")  # fmt: skip
def measure_success(results):
    return bands.measure_success(results)


@query("results", sql=f"""SELECT system, bin, count(*) AS n, round(avg(({OK})::INTEGER), 9) AS success_rate FROM (SELECT *, CAST(coalesce(least(49, greatest(0, ceil((chunk_index - low) * 50 / nullif(high - low, 0)) - 1)), 0) AS INTEGER) AS bin
    FROM (SELECT *, min(chunk_index) OVER (PARTITION BY system) AS low, max(chunk_index) OVER (PARTITION BY system) AS high FROM results)) GROUP BY ALL""")  # fmt: skip
def success_by_equal_bins(results):
    binned = bands.equal_bins(results, "chunk_index", 50, "system")
    return binned.groupBy("system", "bin").agg(F.count("*").alias("n"), F.round(F.avg(summaries.succeeded().cast("int")), 9).alias("success_rate"))


@query("results")
def bootstrap_bands(results):
    """Resampled 95 % bands of success by position bin; rows-only, held against its invariants in the tests."""
    binned = bands.equal_bins(results, "chunk_index", 10, "system").withColumn("success", summaries.succeeded().cast("double"))
    return bands.bootstrap(binned, "success", "system", "bin")


_DRAW = "(resample * 48271 + j * 69621 + 12345) % 2147483647"
_FIRST_DRAW = f"(({_DRAW}) * ({_DRAW}) + 40692 * j + resample) % 2147483647"


@query("results", sql=f"""WITH b AS (SELECT system, ({OK})::INTEGER AS ok, CAST(coalesce(least(9, greatest(0, ceil((chunk_index - low) * 10 / nullif(high - low, 0)) - 1)), 0) AS INTEGER) AS bin
      FROM (SELECT *, min(chunk_index) OVER (PARTITION BY system) AS low, max(chunk_index) OVER (PARTITION BY system) AS high FROM results)),
    g AS (SELECT system, bin, count(*) AS n, count(*) FILTER (WHERE ok = 0) AS zeros, avg(ok) AS mean FROM b GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT *, unnest(range(1, 1001)) AS resample FROM g), d AS (SELECT *, unnest(range(1, n + 1)) AS j FROM r),
    u AS (SELECT *, {_FIRST_DRAW} AS u1 FROM d), v AS (SELECT *, (u1 * u1 + 40692 * (j + 1) + resample) % 2147483647 AS u2 FROM u), w AS (SELECT *, (u2 * u2 + 40692 * (j + 2) + resample) % 2147483647 AS u3 FROM v),
    m AS (SELECT system, bin, any_value(n) AS n, any_value(mean) AS mean, resample, avg((u3 % n >= zeros)::INTEGER) AS resampled FROM w GROUP BY system, bin, resample)
    SELECT system, bin, any_value(n) AS n, round(any_value(mean), 9) AS mean, round(quantile_cont(resampled, 0.025), 9) AS low, round(quantile_cont(resampled, 0.975), 9) AS high FROM m GROUP BY system, bin""".join(("SELECT * FROM (", ")")))
def resampled_bands(results):
    """95 % bands of success by position bin, by 1000 resamples with replacement."""
    binned = bands.equal_bins(results, "chunk_index", 10, "system").withColumn("success", summaries.succeeded().cast("int"))
    found = bands.resampled(binned, "success", "system", "bin")
    return found.select("system", "bin", "n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query("results")
def transition_model(results):
    """The lagged logistic model of each system; rows-only, held against an independent fit in the tests."""
    return transition.fit(transition.lagged(results, "piece_id", "performance"))


_B = """SELECT system, ln(p_s / (1 - p_s)) AS b0, CAST(-0.5 AS DOUBLE) AS b1, CAST(1.25 AS DOUBLE) AS b2, p_s AS pi0 FROM (SELECT system, avg((status = 'success')::INTEGER) AS p_s FROM results GROUP BY system)"""


@query("results", sql=f"""WITH RECURSIVE m AS ({_B}), path AS (SELECT system, 0 AS step, pi0 AS probability FROM m UNION ALL
    SELECT p.system, p.step + 1, p.probability / (1 + exp(-(m.b0 + m.b1 * (p.step + 1) / 99 + m.b2))) + (1 - p.probability) / (1 + exp(-(m.b0 + m.b1 * (p.step + 1) / 99))) FROM path p JOIN m USING (system) WHERE p.step < 99)
    SELECT system, step, round(probability, 9) AS probability FROM path""".replace("WITH RECURSIVE m", "SELECT * FROM (WITH RECURSIVE m") + ")")  # fmt: skip
def markov_marginal(results):
    share = results.groupBy("system").agg(F.avg(summaries.succeeded().cast("int")).alias("pi0"))
    models = share.select("system", F.ln(F.col("pi0") / (1 - F.col("pi0"))).alias("b0"), F.lit(-0.5).alias("b1"), F.lit(1.25).alias("b2"), "pi0")
    return transition.marginal(models).select("system", "step", F.round("probability", 9).alias("probability"))


@query("results")
def fitted_marginal(results):
    """The share of success along a song under the fitted model of each system; rows-only, its start and limits are tested."""
    share = results.groupBy("system").agg(F.avg(summaries.succeeded().cast("int")).alias("pi0"))
    models = transition.fit(transition.lagged(results, "piece_id", "performance")).select("system", "b0", "b1", "b2")
    return transition.marginal(models.join(share, "system")).select("system", "step", F.round("probability", 9).alias("probability"))


@query("results", sql="""SELECT system, round(exp(b), 9) AS odds_ratio, round(1 / (1 + exp(-b)), 9) AS probability, CASE WHEN exp(b) > 10 THEN 'SEVERE' WHEN exp(b) > 3 THEN 'MODERATE' ELSE 'MILD' END AS severity
    FROM (SELECT system, 4 * avg((status = 'success')::INTEGER) AS b FROM results GROUP BY system)""")  # fmt: skip
def odds_and_severity(results):
    b = results.groupBy("system").agg((4 * F.avg(summaries.succeeded().cast("int"))).alias("b"))
    return b.select("system", F.round(transition.odds(F.col("b")), 9).alias("odds_ratio"), F.round(transition.expit(F.col("b")), 9).alias("probability"), transition.severity(transition.odds(F.col("b"))).alias("severity"))


QUERIES, ORACLE_SQL = query.queries, query.sql
