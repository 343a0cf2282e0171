import collections
import pathlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoretables.llm import known_licenses, licenses, packing, queries, tables, urlfilter

PATH = public_tokenizers.path("byte_bpe_50k.json")


def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = max((r for r in urlfilter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and (best[1] + best[2], best[0])


def test_url_rules_and_list(spark):
    urls = [None, "", "nothing", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://a.example.com/en/y?q#f", "http://com/", "http://x.com", "http://xcom/", "http://é.NET/es/?a", "http://y.net/fr/1",
            "http://spam.org/p/", "https://SPAM.org:443/p?utm_source=z#t", "http://spam.org/p/q", "http://u@spam.org/p", "a://b://c/d", "http://x.org?/y", "http://x.org/a\nb"]
    urls += [f"http://site{i}.org/page" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, None), (13, urls[13])], "page_id long, url string").withColumns({"rule": F.lit(1), "canonical": F.lit("c"), "salt": F.lit(3), "key": F.lit(0), "block": F.lit(9)})
    listed = spark.createDataFrame([("http://spam.org/p",), (None,), ("http://spam.org/p/",), ("https://site7.org/page/",)], "url string")
    found = urlfilter.judged(pages, listed).collect()
    assert len(found) == len(urls) + 2
    on_list = {13, 14, urls.index("http://site7.org/page")}
    for r in found:
        host, path, best = url_brute(urls[r.id])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (best or (None, "block" if r.id in on_list else "allow")), urls[r.id]
        assert r.listed is None if best else r.listed == (r.id in on_list)
    assert {r.verdict for r in urlfilter.judged(pages.where("page_id > 20"), listed.where("false")).collect()} == {"allow"}
    assert urlfilter.judged(pages.where("false"), listed).count() == 0


def test_only_possible_hits_are_joined(spark, tmp_path):
    """The exact join reads what passed the filter, whether or not the list is small enough to broadcast."""
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".org/p")).alias("url"))
    listed = pages.where("page_id % 500 = 0").select("url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = urlfilter.judged(pages, listed)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Union" in plan and {r.id for r in rows if r.verdict == "block"} == set(range(0, 5000, 500)) and len(rows) == 5000


def test_long_parts_are_encoded_but_not_held(monkeypatch):
    encoder, library = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(0)
    parts = ["".join(rng.choice(list("aZ09+/"), n)) for n in (10, 64, 65, 3000)]
    body = " ".join(["start", *parts, "end", *parts])
    want = np.array(library.encode(body, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode([body, body]) == [want, want]
    assert set(encoder.known) == {parts[0], parts[1], "end"}
    unbroken = "".join(rng.choice(list("aZ09+/"), 200_000))
    assert encoder.encode([unbroken])[0] == np.array(library.encode(unbroken, add_special_tokens=False).ids, "<u4").tobytes()


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h/"), F.col("id")).alias("canonical"))
    blocks = 1 << (2000 * urlfilter.BITS_PER_URL // 512).bit_length()
    filled = tables.scratch(urlfilter.bloom(listed, blocks), "bloom")
    probe = urlfilter._masked(spark.range(20_000).select("id", F.concat(F.lit("h/"), F.col("id")).alias("canonical")), blocks).join(filled, "block", "left")
    hit = F.lit(True)
    for i in range(urlfilter.WORDS):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col("masks")[i]) == F.col("masks")[i])
    got = {r.id: r.hit for r in probe.select("id", hit.alias("hit")).collect()}
    assert all(got[i] for i in range(2000)) and sum(got[i] for i in range(2000, 20_000)) < 500


def test_licences(spark):
    texts = dict(reversed(known_licenses.TEXTS))  # of each licence the text without a title
    mit = texts["MIT"]
    variant = "Copyright (c) 2020 Ann\n  " + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ;") + "\n© 2021 Bob\nAll rights reserved."
    rows = [(1, mit), (2, variant), (3, mit + " extra"), (4, None), (5, ""), (6, "Copyright 2020 X\n..."), (7, "a\nReleased under the  mit LICENCE\nLicensed under CC BY-NC 4.0.\nb"), (7, mit), (8, "x" * 200_000), (9, "SPDX-License-Identifier: BSD-3-Clause")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "license_id": F.lit("z"), "body": F.lit("b"), "id": F.lit(4)})
    found = sorted((r.id, r.license_id or "", r.notices) for r in licenses.scan(docs).collect())
    assert found == [(1, "MIT", ""), (2, "MIT", ""), (3, "", ""), (4, "", None), (5, "", ""), (6, "", ""), (7, "", "CC-BY-NC-4.0,MIT"), (7, "MIT", ""), (8, "", ""), (9, "", "BSD-3-Clause")]
    assert licenses.scan(docs.where("false")).count() == 0
    own = spark.createDataFrame([("B", "some text"), ("A", "Some TEXT!"), ("C", "...")], "license_id string, body string")
    got = licenses.scan(docs.where("doc_id = 5").unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("SOME - text"))), own).collect()
    assert sorted((r.id, r.license_id or "") for r in got) == [(1, "A"), (5, "")]


def test_every_known_licence_its_spellings_and_near_misses(spark):
    rows = [(i, name, body) for i, (name, body) in enumerate(known_licenses.TEXTS)]
    spelt = [(1000 + i, name, "(c) 1999 Somebody Else\n* " + body.replace("license", "licence").replace("License", "Licence").replace(" ", "\t ").swapcase()) for i, name, body in rows]
    missed = [(2000 + i, None, body + "\nNo warranty is given in Utopia.") for i, _, body in rows]
    docs = spark.createDataFrame([(i, name, body) for i, name, body in (*rows, *spelt, *missed)], "doc_id long, name string, text string")
    want = {r.doc_id: r.name for r in docs.collect()}
    assert {r.id: r.license_id for r in licenses.scan(docs).collect()} == want


def test_digests_of_long_licences(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    there = [(i, name, (folder / file).read_text(encoding="utf-8")) for i, (name, file) in enumerate(files.items()) if (folder / file).exists()]
    if not there:
        pytest.skip("no public licence texts on this machine")
    docs = spark.createDataFrame([(i, t) for i, _, t in there], "doc_id long, text string")
    assert {r.id: r.license_id for r in licenses.scan(docs).collect()} == {i: name for i, name, _ in there}


def sequences(pieces):
    out = collections.defaultdict(list)
    for p in pieces:
        out[p.sequence_id].append(p)
    return out


def test_encoder_equals_the_tokenizer_on_odd_texts():
    plain = Tokenizer.from_file(PATH)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "it's 12 ok", "é\u00a0x y", "<|endoftext|> z", "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext", "tab\tx y", "a b" * 50, "x\u2003 y", "\x1c x", "no\u0085 w"]
    encoder = packing.Encoder(PATH, most=5)
    for _ in range(2):
        assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["the", "ofth", "éa", "zz,"], int(n))), f"s{min(i % 7, 3)}") for i, n in enumerate(rng.integers(0, 900, 150))]
    rows += [(200, "word " * 20_000, "s0"), (201, None, "s1"), (202, "", None), (203, "a b", None), (203, "a b", None), (204, "x <|endoftext|> y", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"key": F.lit("k"), "round": F.lit(1), "start": F.lit(2), "ids": F.lit("i")}).repartition(4)
    plain = Tokenizer.from_file(PATH)
    for how in ({}, {"targets": {"s0": 0.5, "s1": 0.1}}, {"targets": {"s0": 0.0, "s1": 1.0, "s2": -1.0}}, {"temperature": 0.3}):
        pieces = packing.pack(docs, PATH, length=256, window=4, **how).collect()
        wanted = collections.Counter()
        for _, text, _ in rows:
            wanted[np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
        by_doc = collections.defaultdict(list)
        for p in pieces:
            assert len(p.ids) == 4 * p.length
            by_doc[p.id].append(p)
        for i, text, _ in rows:
            if i == 203:
                continue
            ids, at = b"", 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at
                ids, at = ids + bytes(p.ids), at + p.length
            assert wanted[ids] and at == p.doc_tokens
        sizes = []
        for own in sequences(pieces).values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            sizes.append(at)
        assert sum(sizes) == sum(len(x) // 4 * n for x, n in wanted.items())
        assert all(n == 256 or n & (n - 1) == 0 for n in sizes) and sorted(sequences(pieces)) == list(range(len(sizes)))
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_mixture_follows_targets(spark):
    lengths = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(100).cast("long").alias("n_tokens")).withColumnRenamed("id", "key")
    pieces = packing.layout(lengths, {"a": 0.5, "b": 0.5}, length=1000, window=10).join(lengths, "key")
    share = pieces.where("sequence_id < 240").groupBy((F.col("sequence_id") / 20).cast("int").alias("w")).agg((F.sum(F.when(F.col("source") == "a", F.col("length"))) / F.sum("length")).alias("a"))
    assert all(abs(r.a - 0.5) < 0.02 for r in share.collect())


def test_crc_of_pieces(spark):
    docs = spark.createDataFrame([(1, "the end", "s")], "doc_id long, text string, source string")
    r = packing.pack(docs, PATH).select(F.crc32("ids").alias("c"), "ids").first()
    assert r.c == zlib.crc32(bytes(r.ids))


def test_other_tokenizer_files_are_left_to_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    assert encoder.fast is None and packing.Encoder(PATH).fast is not None
    plain = Tokenizer.from_file(path)
    assert encoder.encode(["Hello  World!", ""]) == [np.array(plain.encode("Hello  World!", add_special_tokens=False).ids, "<u4").tobytes(), b""]


def test_sources_without_a_share_come_last_and_dry_queues_give_way(spark):
    lengths = spark.range(3000).select(F.col("id").alias("key"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.lit(100).cast("long").alias("n_tokens"))
    pieces = packing.layout(lengths, {"a": 0.8, "b": 0.2, "c": 0.0}, length=1000, window=10).join(lengths, "key").groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    share = {(r.sequence_id // 10, r.source): 0 for r in pieces}
    for r in pieces:
        share[r.sequence_id // 10, r.source] += r.n
    assert all(abs(share[w, "a"] - 8000) <= 200 for w in range(11)) and all(share.get((w, "b"), 0) == 10_000 for w in range(14, 19))
    assert min(r.sequence_id for r in pieces if r.source == "c") >= 200 - 1 and max(r.sequence_id for r in pieces if r.source != "c") <= 200


def test_registered_packing_query(spark, sf):
    plain = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    pieces = queries.op8_deficit_packing(spark, sf).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*plain.encode(docs[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    ends = {k: sum(p.length for p in own) for k, own in sequences(pieces).items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in ends.values()) and sum(n < 2048 for n in ends.values()) <= 11
