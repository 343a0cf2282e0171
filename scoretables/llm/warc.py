"""WARC archives: write captures as records, read archives back, assemble transactions.

A capture is written as three records that name each other: a request and a metadata record, both concurrent to a
response, or to a revisit where another capture of the same payload is the response. Archives are gzipped text files
of Spark's writer whose line separator is the blank lines that end a record, so lost tasks are committed by Spark.

Archives, also others' (of WARC 1.x, gzipped or not), are read by the text source, split before each ``WARC/1.``, so a
task holds a record and not a file. A payload that itself holds that separator is put together again by the record's
Content-Length. Transactions are assembled by joins on record ids; payloads take part only if they are asked for.

Defined results: every row is a capture, also one that repeats id, url and payload: of such rows one keeps the name
made of these, the others' names take in their number. A null payload is empty; a null url is written without a target;
line breaks in a url are written as %0D and %0A; rows with a null id revisit nothing, are revisited by nothing and are
responses. A record cut short is read with what is there and ``whole`` false, and reading goes on with the next header.
Requests and metadata that lead to no response or revisit are captures of their own without one. No pages give an
empty archive.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretables.llm import tables

EOL = "\r\n"
DATE = "1970-01-01T00:00:00Z"
_BREAK = b"\r\n\r\nWARC/1."
RECORD = """record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, content_type string, head string,
    payload binary, payload_bytes long, payload_digest string, fields string, whole boolean"""


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every five hex digits make four base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(kind: str, *parts: Column) -> Column:
    plain = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(plain, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(block: Column, **fields: Column) -> Column:
    """A record without the blank lines that end it."""
    head = [F.concat(F.lit(f"WARC-{k.replace('_', '-')}: " if k[0].isupper() else f"{k.replace('_', '-').title()}: "), v.cast("string"), F.lit(EOL)) for k, v in fields.items()]
    return F.concat(F.lit(f"WARC/1.1{EOL}"), *(F.coalesce(x, F.lit("")) for x in head), F.lit(EOL), block)


def _named(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` with ``own`` (the capture's record id), and ``first`` and ``first_own`` (id and record id of the capture that it revisits, or null).

    Of equal payloads the row with the largest id, then the largest url, is the response. What is shuffled or joined has
    no payloads; only rows that repeat another one whole are written, to be told apart.
    """
    rows = rows.withColumn("name", _uuid("capture", F.col("id"), F.col("url"), F.col("digest")))
    names = rows.select("name", "id", "url", "digest", "size").groupBy("name", "id", "url", "digest", "size").agg(F.count("*").alias("n"))
    names = tables.scratch(names, "names")
    able = names.where((F.col("size") >= least_bytes) & F.col("id").isNotNull())
    best = F.max(F.struct("id", "url", "name")).alias("best")
    shared = able.groupBy("digest").agg(best, F.sum("n").alias("total")).where("total > 1").select("digest", F.col("best.id").alias("first"), F.col("best.name").alias("first_own"))
    copies = able.join(tables.scratch(shared, "shared"), "digest").select("name", "first", "first_own", "n")
    copies = copies.unionByName(names.where("n > 1").join(able.select("name"), "name", "left_anti").select("name", F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_own"), "n"))
    # As a written table its size is known: it is broadcast only if it is small, else the pages are shuffled by name.
    copies = tables.scratch(copies, "copies")
    found = rows.join(copies, "name", "left")
    if copies.where("n > 1").isEmpty():
        found = found.withColumn("own", F.col("name"))
    else:
        again = tables.scratch(found.where("n > 1").withColumn("number", F.monotonically_increasing_id()), "repeated")
        lead = tables.scratch(again.groupBy("name").agg(F.min("number").alias("lead")), "leads")
        own = F.when(F.col("number") == F.col("lead"), F.col("name")).otherwise(_uuid("again", F.col("name"), F.col("number")))
        again = again.join(lead, "name").withColumn("own", own).drop("number", "lead")
        found = found.where("n is null or n = 1").withColumn("own", F.col("name")).unionByName(again)
    is_first = F.col("own") == F.col("first_own")
    return found.withColumns({c: F.when(~is_first, F.col(c)) for c in ("first", "first_own")})


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """One column ``value`` with three records for each page.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = _named(rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload")), least_bytes)

    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = F.col("own")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=UTF-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL * 2))
    target = F.coalesce(F.nullif(F.regexp_extract(uri, r"^(?s:.*?)://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(F.regexp_extract(uri, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), F.lit(EOL * 2))
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(EOL))
    common = {"Target_URI": uri, "Date": F.lit(DATE)}
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _record(asked, Type=F.lit("request"), Record_ID=_uuid("request", own), Concurrent_To=own, **common, content_type=F.lit("application/http;msgtype=request"), content_length=F.octet_length(asked))
    body = F.concat(http, F.col("payload").cast("string"))
    response = _record(body, Type=F.lit("response"), Record_ID=own, Payload_Digest=digest, **common, content_type=F.lit("application/http;msgtype=response"), content_length=F.octet_length(http) + F.col("size"))
    revisit = _record(http, Type=F.lit("revisit"), Record_ID=own, Payload_Digest=digest, Refers_To=F.col("first_own"), Profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), **common, content_type=F.lit("application/http;msgtype=response"), content_length=F.octet_length(http))
    metadata = _record(notes, Type=F.lit("metadata"), Record_ID=_uuid("metadata", own), Concurrent_To=own, **common, content_type=F.lit("application/warc-fields"), content_length=F.octet_length(notes))
    return rows.select(F.explode(F.array(request, F.when(F.col("first").isNull(), response).otherwise(revisit), metadata)).alias("value"))


def write(archive: DataFrame, path: str) -> None:
    archive.write.option("lineSep", EOL * 2).option("compression", "gzip").text(path)


def _parsed(head: bytes, block: bytes, whole: bool, with_payload: bool) -> dict:
    fields: dict[str, list[str]] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.decode("latin-1").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    one = lambda name: fields.get(name, [None])[0]
    kind, declared = one("warc-type"), one("warc-payload-digest")
    http = (one("content-type") or "").startswith("application/http")
    top, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        sizes = [x.partition(b":")[2] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].strip().isdigit() else None
        digest = declared.partition(":")[2] if declared else None
    return {
        "record_id": one("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
        "uri": one("warc-target-uri"), "date": one("warc-date"), "content_type": one("content-type"), "head": top.decode("latin-1"),
        "payload": payload if with_payload and kind != "revisit" else None, "payload_bytes": size, "payload_digest": digest,
        "fields": block.decode("utf-8", "replace") if one("content-type") == "application/warc-fields" else None, "whole": whole,
    }


def _length(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        if line[:15].lower() == b"content-length:" and line[15:].strip().isdigit():
            return int(line[15:])
    return 0


def _records_of(pieces, with_payload: bool):
    """Records from pieces of archives cut at the separator.

    A record that is shorter than its declared length takes in the pieces after it, as long as the length is met where
    a piece ends. If it isn't, the record was cut short, and those pieces are records of their own.
    """
    left: list[bytes] = []
    source = iter(pieces)

    def following():
        return left.pop() if left else next(source, None)

    while (piece := following()) is not None:
        head, blank, body = piece.partition(b"\r\n\r\n")
        if not blank and b":" not in head:
            continue
        size = _length(head)
        parts, have, taken = [body], len(body), []
        while have < size and (more := following()) is not None:
            if more.startswith(b"WARC/1."):  # the first piece of another file
                left.append(more)
                break
            # A payload that begins with the separator's text shares its blank lines with the end of the header.
            parts.append((_BREAK if blank or taken else _BREAK[4:]) + more)
            taken.append(more)
            have += len(parts[-1])
        block = b"".join(parts)
        if taken and (have < size or block[size:].strip(b"\r\n")):
            left += reversed(taken)
            block = body
        yield _parsed(head, block[:size], len(block) >= size, with_payload)


def _each_file_whole(raw: DataFrame, path: str):
    """Settings under which no plain archive is split, as a separator in a payload looks like one between records."""
    spark = raw.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"\.gz$"))
    most = files.agg(F.max("length").alias("n")).first().n
    return {"spark.sql.files.maxPartitionBytes": str(most), "spark.sql.files.minPartitionNum": "1"} if most else {}


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A written table of the archives' records; ``payload``: with the payloads, not only their size and digest."""

    def run(batches):
        out, size = [], 0
        pieces = (x for batch in batches for x in batch.column(0).to_pylist() if x is not None)
        for record in _records_of(pieces, payload):
            out.append(record)
            size += len(record["payload"] or b"")
            if len(out) >= 2000 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    names = pa.list_(pa.string())
    types = {"string": pa.string(), "array<string>": names, "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    kind = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RECORD.replace("\n", " ").split(",")])
    raw = spark.read.option("lineSep", _BREAK.decode()).text(path)
    settings = _each_file_whole(raw, path)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return tables.scratch(raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD), "records")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture`` (its id), ``response``, ``request``, ``metadata`` (structs or null), ``n_requests``, ``n_metadata``.

    ``response`` is a response or revisit. Others belong to the one that they are concurrent to, that names them as
    concurrent, or that a record which they are concurrent to belongs to. Of several requests (or metadata records) of
    a capture the nested one has the smallest id, and all are counted. ``found``: a written table, as read() gives it.
    """
    is_first, known = F.col("type").isin("response", "revisit"), F.col("record_id").isNotNull()
    ends = found.where(known).select("type", "record_id", F.explode("concurrent_to").alias("to"))
    links = ends.select(F.when(is_first, F.col("to")).otherwise(F.col("record_id")).alias("member"), F.when(is_first, F.col("record_id")).otherwise(F.col("to")).alias("target"))
    links = tables.scratch(links.distinct(), "links")
    ids = tables.scratch(found.where(is_first & known).select(F.col("record_id").alias("target")).distinct(), "captures")
    near = tables.scratch(links.join(ids, "target").groupBy("member").agg(F.min("target").alias("capture")), "near")
    far = links.join(near, "member", "left_anti").join(near.withColumnRenamed("member", "target"), "target").groupBy("member").agg(F.min("capture").alias("capture"))
    owner = near.unionByName(far).withColumnRenamed("member", "record_id")
    everything, part = F.struct(*found.columns), ("response", "request", "metadata")
    kind = F.when(is_first, F.lit("response")).when(F.col("type").isin("request", "metadata"), F.col("type")).alias("kind")
    # A record that is there twice is one record.
    single = found.where(known).groupBy("record_id", kind).agg(F.min_by(everything, F.coalesce("uri", F.lit(""))).alias("record")).where("kind is not null")
    owned = single.join(owner, "record_id", "left").withColumn("capture", F.when(F.col("kind") == "response", F.col("record_id")).otherwise(F.coalesce("capture", "record_id")))
    of = lambda k: F.when(F.col("kind") == k, F.col("record_id"))
    nested = owned.groupBy("capture").agg(*(F.min_by("record", of(k)).alias(k) for k in part), *(F.count(of(k)).alias(f"n_{k}s") for k in ("request",)), F.count(of("metadata")).alias("n_metadata"))
    return nested.select("capture", *part, "n_requests", "n_metadata")
