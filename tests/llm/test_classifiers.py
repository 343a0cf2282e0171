import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scoretables.llm import langid, quality, queries, tables, text, toxicity

ODD = [(900, None), (901, ""), (902, " "), (903, "12 ½ ²"), (904, "word " * 30_000), (None, "no id"), (905, "twice"), (905, "twice")]


def test_fold_is_crc32_of_the_decimal_text(spark):
    got = spark.createDataFrame([(i,) for i in (0, 5, 12345)] + [(None,)], "i long").select(tables.fold(F.col("i"), 3)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 3 for i in (0, 5, 12345)] + [0]


def test_bounded_sample(spark):
    df = spark.range(10_000)
    assert tables.bounded_sample(df, [F.col("id")], 20_000).count() == 10_000
    assert 800 < tables.bounded_sample(df, [F.col("id")], 1000).count() < 1200


def two_languages(n=80):
    rng = random.Random(2)
    a, b = ["rakto", "melin", "sova", "ent"], ["bruhh", "dzek", "och", "zzat"]
    return [(i, " ".join(rng.choices(a if i % 2 else b, k=12)), "aa" if i % 2 else "bb") for i in range(n)]


def told(model, *texts):
    best, score = model.predict(pa.array(texts, pa.string()))
    return [("und" if k < 0 else model.languages[k], s) for k, s in zip(best.tolist(), score.tolist(), strict=True)]


def test_language_words_backoff_and_odd_texts(spark):
    docs = spark.createDataFrame([*two_languages(), (500, "x", None), *((i, t, None) for i, t in ODD)], "doc_id long, text string, lang string").withColumns({"row": F.lit(1), "body": F.lit("zz"), "score": F.lit(2)})
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb"]
    assert [x[0] for x in told(model, "Rakto SOVA", "raktorakto", "dzekoch!")] == ["aa", "aa", "bb"]
    assert told(model, None, "", "12 ½ ²", "...", "_") == [("und", 0.0)] * 5
    found = langid.identify(docs, model, keep=tuple(docs.columns))
    assert found.count() == docs.count() and found.where("not (score between 0 and 1)").count() == 0
    assert found.where("row.lang is not null and row.lang <> lang_pred").count() == 0
    empty = langid.fit(docs.where("false"))
    assert told(empty, "rakto") == [("und", 0.0)] and langid.identify(docs.where("false"), empty).count() == 0


def test_longest_known_order_is_used():
    def key(gram):
        data = np.frombuffer(gram.encode(), np.uint8)
        return text.span_hashes(text.prefix_sums(data), np.array([0]), np.array([len(data)]))[0]

    keys = np.array([key("<ab"), key("a"), key("b")])
    order = np.argsort(keys)
    table = np.array([[-0.1, -3.0], [-3.0, -0.1], [-3.0, -0.1]], np.float32)[order]
    model = langid.Model(["x", "y"], np.zeros(0, np.uint64), np.zeros((0, 2)), keys[order], table)
    assert [x[0] for x in told(model, "abq", "qa")] == ["x", "y"]


def test_equally_likely_languages_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "one two", "b"), (2, "one two", "a"), (3, "three four", "c")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    (first, s), (long, _) = told(model, "two one", "one " * 200_000 + "three")
    assert (first, long) == ("a", "a") and 0.33 < s <= 0.5


def test_small_languages_keep_their_rows_under_the_bound(spark):
    rows = [(i, f"common word{i % 50}", "big") for i in range(2000)] + [(5000 + i, f"rare term{i}", "small") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bound=100)
    assert told(model, "rare term")[0][0] == "small" and told(model, "common")[0][0] == "big"


def language_brute(rows, held):
    """Predictions of plain Python, from (doc_id, text, lang) and the ids that teach nothing."""
    def words(t):
        return "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()

    counts, grams = {}, {}
    for i, t, lang in rows:
        if lang is not None and t is not None and i not in held:
            for w in words(t):
                counts.setdefault(w, Counter())[lang] += 1
    names = sorted({x for c in counts.values() for x in c})
    for w, c in counts.items():
        for lang in c:
            for order in langid.ORDERS:
                for k in range(len(w) + 3 - order):
                    grams.setdefault(f"<{w}>"[k : k + order], Counter())[lang] += 1

    def logs(table):
        size = [sum(c[x] for c in table.values()) for x in names]
        out = {}
        for item, c in table.items():
            v = np.array([math.log((c[x] + 0.5) / (n + 0.5 * (len(table) + 1))) for x, n in zip(names, size, strict=True)])
            out[item] = v - math.log(np.exp(v).sum())
        return out

    word_logs = logs(counts)
    gram_logs = {}
    for order in langid.ORDERS:
        gram_logs |= logs({g: c for g, c in grams.items() if len(g) == order})
    found = {}
    for i, t, _ in rows:
        ws = words(t)
        total = np.zeros(len(names))
        for w in ws:
            if w in word_logs:
                total += word_logs[w]
                continue
            for order in langid.ORDERS:
                own = [gram_logs[g] for k in range(len(w) + 3 - order) if (g := f"<{w}>"[k : k + order]) in gram_logs]
                if own:
                    total += np.mean(own, axis=0)
                    break
        if ws:
            total *= min(1, langid.EVIDENCE / len(ws))
            found[i] = names[int(total.argmax())], 1 / np.exp(total - total.max()).sum()
        else:
            found[i] = "und", 0.0
    return found


def test_registered_language_query_against_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    wanted = language_brute(rows, {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1})
    got = queries.op2_language_backoff(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        name, score = wanted[r.doc_id]
        assert r.lang_pred == name and abs(r.score - score) < 1e-4 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def labelled_texts(n=160):
    rng = random.Random(4)
    words = [f"plain{i}" for i in range(40)]
    rows = []
    for i in range(n):
        ws = rng.choices(words, k=rng.randint(5, 60))
        if i % 4 == 0:
            ws = [w + "###" for w in ws]
            ws.insert(rng.randrange(len(ws)), "vilestem" + rng.choice(["a", "bcd", "xyz"]))
        rows.append((i, " ".join(ws), 0 if i % 4 == 0 else 1, 1 if i % 4 == 0 else 0))
    return rows


def labels_of(spark, rows):
    extra = [(rows[0][0], None, None), (777, 1, 0), (None, 1, 1)]
    return spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + extra, "doc_id long, quality int, toxic int")


def test_quality_separates_and_scores_odd_texts(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + ODD, "doc_id long, text string").withColumns({"y": F.lit(5), "key": F.lit("k"), "x": F.lit(1)})
    labels = labels_of(spark, rows)
    model = quality.fit(docs, labels.where("doc_id % 3 <> 1 or doc_id is null"))
    found = quality.score(docs, model)
    assert found.count() == docs.count() and found.where("score is null or not (score between 0 and 1)").count() == 0
    got = {r.id: r.score for r in found.collect()}
    assert all((got[r[0]] >= 0.5) == (r[2] == 1) for r in rows)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.score(docs.where("false"), model).count() == 0
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    found = quality.score(named(docs), quality.fit(named(docs), named(labels))).collect()
    assert len(found) == docs.count() and all(r.score >= 0.5 for r in found if r.id == f"d{rows[1][0]}")


def test_isotonic_pools_adjacent_violators():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]
    rng = np.random.default_rng(0)
    x, y = quality.isotonic(rng.normal(size=500), rng.integers(0, 2, 500).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def test_statistics_by_hand():
    x = quality.statistics(pa.array(["Ab 1\nAb 1", None, ""]))
    assert x.shape == (3, quality.WIDTH) and np.isfinite(x).all() and (x[1] == x[2]).all()
    assert np.isclose(x[0, 4] ** 2, 2 / 9) and np.isclose(x[0, quality._CLASSES + 5], 0.5) and np.isclose(x[0, quality._CLASSES + 7], 0.5)


def test_registered_quality_query_against_one_process(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("part")).orderBy("doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    x = quality.statistics(pa.array([r.text for r in docs], pa.string()))
    learn = np.array([labels.get(r.doc_id) is not None for r in docs])
    y, part = np.array([labels.get(r.doc_id) or 0 for r in docs], float)[learn], np.array([r.part for r in docs])[learn]
    z = quality.Fourier(x[learn].mean(axis=0), x[learn].std(axis=0))(x)
    ridge = lambda a, b: np.linalg.lstsq(np.vstack([a, np.sqrt(quality.RIDGE) * np.eye(a.shape[1])]), np.concatenate([b, np.zeros(a.shape[1])]), rcond=None)[0]
    own = z[learn]
    unseen = np.array([own[i] @ ridge(own[part != part[i]], y[part != part[i]]) for i in range(len(y))])
    order = np.argsort(unseen, kind="stable")
    s, t = unseen[order], y[order]
    # The isotonic fit as the largest of the smallest means of runs; its pools are runs of equal values.
    means = lambda i, j: t[i : j + 1].mean()
    fit = np.array([max(min(means(i, j) for j in range(k, len(t))) for i in range(k + 1)) for k in range(0, len(t))])
    edges = np.flatnonzero(np.abs(np.diff(fit)) > 1e-12) + 1
    knots = [(c.mean(), v.mean()) for c, v in zip(np.split(s, edges), np.split(fit, edges), strict=True)]
    wanted = np.clip(np.interp(z @ ridge(own, y), *zip(*knots, strict=True)), 0, 1)
    got = {r.doc_id: r for r in queries.op4_quality_ridge(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, wanted, strict=True):
        assert abs(got[r.doc_id].score - w) < 1e-6 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_toxicity_finds_stems_and_scores_odd_texts(spark):
    rows = labelled_texts(240)
    docs = spark.createDataFrame([(r[0], r[1].replace("###", "")) for r in rows] + ODD, "doc_id long, text string").withColumns({"y": F.lit(5), "key": F.lit("k"), "row": F.lit(1), "ids": F.lit("i"), "lang": F.lit("x")})
    labels = labels_of(spark, rows)
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1 or doc_id is null"))
    found = toxicity.score(docs, model, keep=tuple(docs.columns))
    assert found.count() == docs.count() and found.where("score is null or not (score between 0 and 1)").count() == 0
    got = {r.row.doc_id: r.score for r in found.collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([(got[r[0]] >= 0.5) == (r[3] == 1) for r in held]) > 0.9
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}


def test_toxicity_scores_against_loops():
    rng = np.random.default_rng(3)
    bodies = [" ".join(rng.choice(["alpha", "betas", "gammagamma", "dd", "é"], n)) for n in (1, 2, 3, 17)] + ["", None, "... !"]
    net = toxicity.Network()
    texts = toxicity.Texts.of(pa.array(bodies, pa.string()))
    got = net.score(texts.ids, texts.bounds[:-1])
    for t, score in enumerate(got):
        own = texts.ids[:, texts.bounds[t] : texts.bounds[t + 1]]
        n = own.shape[1]
        vec = [np.concatenate([net.embed[h, own[h, i]] for h in range(len(own))]) for i in range(n)]
        logit = float(net.out_bias[0])
        for w, (width, f, b) in enumerate(zip(toxicity.WIDTHS, net.filters, net.bias, strict=True)):
            for j in range(toxicity.FILTERS):
                top = max(b[j] + sum(float(vec[i + k] @ f[k, :, j]) for k in range(width) if i + k < n) for i in range(n))
                logit += max(top, 0) * float(net.out[w * toxicity.FILTERS + j])
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-5
    again = toxicity.Texts.unpacked(texts.packed())
    assert (again.ids == texts.ids).all() and (again.bounds == texts.bounds).all()


def test_maxima_run_on_from_piece_to_piece(monkeypatch):
    rng = np.random.default_rng(5)
    bodies = [" ".join(rng.choice([f"w{i}" for i in range(50)], n)) for n in (1, 40, 0, 7, 200, 3)]
    net, texts = toxicity.Network(), toxicity.Texts.of(pa.array(bodies))
    whole = net.maxima(texts.ids, texts.bounds[:-1])[-1]
    for piece in (1, 2, 3, 16, 57, 10_000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(net.tops(texts.ids, texts.bounds[:-1]), whole, atol=1e-5)


def test_stretched_scores_keep_their_order():
    raw = np.linspace(0, 1, 201)
    for low, cut, high in ((0.2, 0.3, 0.6), (0.2, 0.2, 0.6), (0.2, 0.6, 0.6), (0.4, 0.4, 0.4), (1e-6, 1e-6, 1 - 1e-6)):
        got = toxicity.stretched(raw, low, np.full(201, cut), high)
        assert (np.diff(got) >= 0).all() and got[0] >= 0 and got[-1] <= 1 and ((got >= 0.5) == (raw >= cut)).all()


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(1)
    texts = toxicity.Texts.of(pa.array([" ".join(rng.choice(["aa", "bb", "cc", "dd"], 40)), "aa", ""]))
    net = toxicity.Network()
    for name in ("filters", "bias"):
        setattr(net, name, [x.astype(float) for x in getattr(net, name)])
    for b in net.bias:
        b += rng.normal(0, 0.1, b.shape)  # away from the kink that padding has at zero
    net.embed, net.out, net.out_bias, y = net.embed.astype(float), net.out.astype(float), net.out_bias.astype(float), np.array([1.0, 0, 1])
    found = {}
    net._down = lambda value, gradient, rate, at=...: found.setdefault(id(value), gradient)

    def loss():
        p = net.score(texts.ids, texts.bounds[:-1])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    net.step(texts.ids, texts.bounds[:-1], y, 0.0)
    for value, at in ((net.filters[1], (1, 0, 2)), (net.filters[2], (2, 5, 1)), (net.bias[0], (3,)), (net.out, (2,)), (net.out, (20,)), (net.out_bias, (0,))):
        gradient = found[id(value)][at]
        before = value[at]
        value[at] = before + 1e-5
        up = loss()
        value[at] = before - 1e-5
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-5 - gradient) < 1e-4


def test_thresholds_by_language():
    model = toxicity.Model(None, 0.25, None, {None: 0.5})
    assert model.score(pa.array(["a", None])).tolist() == [0.25, 0.25]
    assert toxicity._threshold(np.array([0.1, 0.2, 0.8]), np.array([0.0, 0, 1])) == 0.5


def test_held_out_accuracy_of_the_registered_queries(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    rows = {r.doc_id: r for r in truth.collect()}
    for name, column, least in (("op2_language_backoff", "lang", 0.97), ("op4_quality_ridge", "quality", 0.95), ("op9_toxicity_cnn", "toxic", 0.85)):
        found = [r for r in queries.QUERIES[name](spark, d).collect() if r.held_out and rows[r.doc_id][column] is not None]
        hits = [(r.lang_pred if column == "lang" else r.predicted) == rows[r.doc_id][column] for r in found]
        assert len(hits) > 40 and np.mean(hits) >= least, (name, np.mean(hits))


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Training took a sample of the rows; here shards of a few rows must all be met and give one network."""
    monkeypatch.setattr(toxicity, "STEPS", 80)
    rows = labelled_texts(240)
    docs = spark.createDataFrame([(r[0], r[1].replace("###", "")) for r in rows], "doc_id long, text string")
    labels = labels_of(spark, rows)
    met = []
    trained, thresholds = toxicity.trained, toxicity.thresholds
    monkeypatch.setattr(toxicity, "trained", lambda df: met.extend(map(tuple, df.collect())) or trained(df))
    monkeypatch.setattr(toxicity, "thresholds", lambda df, n: met.extend((-1, *r) for r in df.select("y", "ids").collect()) or thresholds(df, n))
    model = toxicity.fit(docs, labels, shard_bytes=8_000)
    assert len(met) == 240 and len({m[0] for m in met}) > 3 and sum(m[1] for m in met) == 60
    held = docs.where("doc_id % 4 < 2")
    got = {r.row.doc_id: r.score for r in toxicity.score(held, model).collect()}
    assert np.mean([(got[r[0]] >= 0.5) == (r[3] == 1) for r in rows if r[0] in got]) > 0.9

    texts, y = toxicity.Texts.of(pa.array([r[1] for r in rows])), np.array([r[3] for r in rows], np.float32)
    seen = set()

    class Watch:
        def step(self, ids, starts, labels, rate):
            seen.update(b.tobytes() for b in np.split(ids, starts[1:], axis=1))

    for turn in range(toxicity.ROUNDS):
        toxicity._learn(Watch(), texts, y, 0, turn)
    assert seen == {x for x in texts.packed()}


def test_toxicity_moves_no_text_to_the_labels(spark, monkeypatch):
    """Labels too many to be broadcast were joined by a shuffle of all texts; now few texts without a label become bucket
    numbers, and these are moved once, to their shards. Keys of two types, null and repeated keys stay right."""
    monkeypatch.setattr(toxicity, "STEPS", 80)
    rows = labelled_texts(240)
    spare = [(i, "without a label " * 20) for i in range(1000, 4000)] + ODD + [(rows[4][0], "another text")]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + spare, "doc_id long, text string")
    labels = labels_of(spark, [*rows, (rows[5][0], 0, 1, 0)]).withColumn("doc_id", F.col("doc_id").cast("int"))
    written = {}
    scratch = tables.scratch

    def spy(df, name, **options):
        written[name] = df._jdf.queryExecution().executedPlan().toString(), (out := scratch(df, name, **options))
        return out

    monkeypatch.setattr(tables, "scratch", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = toxicity.fit(docs, labels, shard_bytes=8_000)
        plan, ids = written["toxic"]
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        plan, dealt = written["toxic-shards"]
        assert plan.count("hashpartitioning") == 1
        assert ids.count() < 241 + 300
        got = sorted((r.key, r.y) for r in dealt.collect())
        assert got == sorted([(r[0], r[3]) for r in rows] + [(rows[4][0], rows[4][3])])
        assert dealt.select("shard").distinct().count() > 2 and model.network is not None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
