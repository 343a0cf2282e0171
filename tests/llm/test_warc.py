import base64
import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from scoretables.llm import queries
from scoretables.llm import warc as W
from scoretables.llm.tables import scratch_path


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def page_of(found):
    return found.select(F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).alias("page"), "response.*", "n_requests", "n_metadata", F.col("request.uri").alias("asked"))


def test_round_trip_of_odd_payloads(spark):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: request\r\n\r\n\r\n\r\nWARC/1.\r\n\r\n"
    rows = [(1, "http://a.com/b?c#d", "<p>é</p>"), (2, "https://b.org", "<p>é</p>"), (3, None, None), (4, "no scheme", ""), (5, "http://a\r\nX: y/", nasty), (6, "http://c.net/", nasty), (7, "http://d.net/", "z" * 300_000), (8, "u", "\r\n\r\n"), (8, "u", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2), "size": F.lit("s"), "id": F.lit(0)}).repartition(3)
    path = scratch_path(spark, "t")
    W.write(W.records(pages), path)
    found = page_of(W.assemble(W.read(spark, path))).collect()
    assert len(found) == 9 and len({r.record_id for r in found}) == 9
    assert sorted((r.type, r.refers_to is None) for r in found if r.page == "8") == [("response", True), ("revisit", False)]
    by = {int(r.page): r for r in found if r.page != "8" or r.type == "response"}
    assert sorted(by) == list(range(1, 9))
    for i, url, html in rows:
        body = (html or "").encode()
        first = max(j for j, _, h in rows if (h or "") == (html or ""))
        r = by[i]
        assert (r.payload_bytes, r.payload_digest, r.type, r.whole) == (len(body), digest(body), "response" if first == i else "revisit", True)
        assert (r.payload == body) if first == i else (r.payload is None and r.refers_to == by[first].record_id)
        assert r.asked == r.uri == (url and url.replace("\r", "%0D").replace("\n", "%0A")) and (r.n_requests, r.n_metadata) == (1, 1)
    W.write(W.records(pages.where("false")), path + "-empty")
    assert W.assemble(W.read(spark, path + "-empty")).count() == 0


def test_binary_payloads_and_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", bytearray(range(256))), (2, "u", bytearray(range(256))), (3, "u", bytearray(b"s")), (4, "u", bytearray(b"s"))], "page_id long, url string, html binary")
    path = scratch_path(spark, "t")
    W.write(W.records(pages, least_bytes=10), path)
    found = {int(r.page): r for r in page_of(W.assemble(W.read(spark, path))).collect()}
    assert bytes(found[2].payload) == bytes(range(256)) and [found[i].type for i in (1, 2, 3, 4)] == ["revisit", "response", "response", "response"]


def test_foreign_archive_with_links_the_other_way(spark, tmp_path):
    def record(kind, name, block, *more, length=None):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block) if length is None else length}"]
        return "\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http"
    parts = [
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n", http),
        record("response", "r", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Concurrent-To: <q>", "WARC-Concurrent-To: <other>"),
        record("metadata", "m", b"a: b\r\n", "WARC-Concurrent-To: <q>", "Content-Type: application/warc-fields"),
        record("metadata", "lost", b"c: d\r\n", "WARC-Concurrent-To: <nowhere>", "Content-Type: application/warc-fields"),
        record("response", "cut", b"HTTP/1.1 200 OK\r\n\r\nhal", http, length=999),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    found = {r.capture: r for r in W.assemble(W.read(spark, str(tmp_path))).collect()}
    assert set(found) == {"<r>", "<lost>", "<cut>"}
    assert found["<r>"].request.record_id == "<q>" and found["<r>"].metadata.record_id == "<m>" and bytes(found["<r>"].response.payload) == b"body"
    assert found["<lost>"].response is None and found["<lost>"].metadata.fields == "c: d\r\n"
    assert not found["<cut>"].response.whole


def wanted(rows):
    """What the contract asks for each row (id, url, html), as a count of result rows."""
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out, taken = Counter(), set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, [-ord(c) for c in r[1] or ""])):
        body = h or ""
        first = i is None or (best[body] == i and body not in taken)
        if i is not None and first:
            taken.add(body)
        out[i, len(body.encode()), digest(body.encode()), "response" if first else "revisit", None if first else best[body]] += 1
    return out


def test_registered_query_on_odd_rows(spark, sf, tmp_path):
    rows = [(1, "http://a/x", "same"), (1, "http://b/y", "same"), (None, "http://n/", "same"), (None, "http://n/", "same"), (None, None, None), (2, "u", "once"), (3, "v", "same"), (3, "v", "same"), (3, "v", "same"), (4, "w", ""), (5, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n": F.lit(1), "own": F.lit("o"), "first_own": F.lit(0)}).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op1_warc_transactions(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == wanted(rows)
    assert Counter(r.uri for r in found) == Counter(r[1] for r in rows)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    found = queries.op1_warc_transactions(spark, sf).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == wanted(rows)


def plain_record(name, block, length=None):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_reading_goes_on_after_a_cut_record(spark, tmp_path):
    for length in (400, 90, 10_000):
        path = tmp_path / str(length)
        path.mkdir()
        (path / "a.warc").write_bytes(plain_record("one", b"1" * 50) + plain_record("cut", b"2" * 20, length) + plain_record("three", b"3" * 60) + plain_record("four", b"4"))
        (path / "b.warc").write_bytes(plain_record("five", b"5"))
        found = {r.record_id: (bytes(r.payload), r.whole) for r in W.read(spark, str(path)).collect()}
        assert found == {"<one>": (b"1" * 50, True), "<cut>": (b"2" * 20, False), "<three>": (b"3" * 60, True), "<four>": (b"4", True), "<five>": (b"5", True)}


def test_plain_archives_are_not_split_inside_payloads(spark, tmp_path):
    inner = b"\r\n\r\n".join(plain_record(f"inner{k}", b"i" * 700) for k in range(40))
    (tmp_path / "a.warc").write_bytes(plain_record("outer", inner) + plain_record("next", b"n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r.record_id: bytes(r.payload) for r in W.read(spark, str(tmp_path)).collect()}
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "4096"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes") if before is None else spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {"<outer>": inner, "<next>": b"n"}


def test_payloads_that_spell_the_separator(spark, tmp_path):
    edge = b"\r\n\r\nWARC/1."
    payloads = [b"WARC/1.0", b"WARC/1.", edge, edge + edge, b"WARC/1." + edge, b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc", b"one" + edge + b"0\r\ntwo", b"", b"WARC/1.1\r\n\r\n", b"last"]
    for kind in ("plain", "gzip"):
        folder = tmp_path / kind
        folder.mkdir()
        parts = [plain_record(f"r{k}", p) for k, p in enumerate(payloads)]
        if kind == "plain":
            (folder / "a.warc").write_bytes(b"".join(parts))
        else:
            (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
        found = {r.record_id: (bytes(r.payload), r.whole, r.payload_digest) for r in W.read(spark, str(folder)).collect()}
        assert found == {f"<r{k}>": (p, True, digest(p)) for k, p in enumerate(payloads)}
