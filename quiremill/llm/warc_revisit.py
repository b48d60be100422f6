"""WARC: not-modified revisits, resolved by an as-of join on the canonical URL.

A revisit (status 304) stands for the latest earlier full response of its canonical
URL. That response must agree with the revisit's validators; then the stored headers
are merged with those that a 304 may renew.

The join never brings all captures of a URL into one task: captures are dealt out by
ranges of (URL, time), the latest response is carried forward within a range, and the
few URLs that run over a border get their last response from the ranges before it,
which is at most one row for each border.

Defined results: a null URL or time resolves to nothing ("none"); of responses at the
same time the one with the larger id counts, and a response at the revisit's own time
is not earlier; a revisit without validators is "unchecked" and takes the response; one
whose validators differ is a "mismatch" and takes none; repeated rows resolve alike;
an empty table gives an empty table; further columns, those named like results among
them, are ignored. Records of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import written

# Fields that describe the stored body or one connection, and that a 304 does not renew.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Records that are handed on at once.
RECORDS = 256
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www., default port, fragment, index page, last slash and tracking parameters."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/(index\.html?)?$", "")
    parts = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(F.array_sort(parts), "&")
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", full)


_RECORD = "record_id string, url string, ts long, type string, status int, headers map<string,string>, payload binary, path string, error string"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _record(stream, path: str | None) -> tuple | None:
    """The record whose first line has been read; None where it is neither a response nor a revisit."""
    from datetime import datetime

    head = []
    while (line := stream.readline()).strip():
        head.append(line)
    known, error, ts = _fields(head), None, None
    size = known.get("content-length", "0")
    if not size.isdigit():
        return (known.get("warc-record-id", ""), known.get("warc-target-uri"), None, known.get("warc-type"), None, None, None, path, f"bad Content-Length {size}")
    body = stream.read(int(size))
    if len(body) < int(size):
        error = "the record ends early"
    if known.get("warc-type") not in ("response", "revisit"):
        return None
    if when := known.get("warc-date"):
        try:
            ts = int(datetime.fromisoformat(when.replace("Z", "+00:00")).timestamp())
        except ValueError:
            error = f"bad WARC-Date {when}"
    top, _, payload = body.partition(b"\r\n\r\n")
    status, *rest = top.split(b"\r\n")
    words = status.split()
    code = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) < 4 else None
    return (known.get("warc-record-id", ""), known.get("warc-target-uri"), ts, known["warc-type"], code, list(_fields(rest).items()), payload, path, error)


def _records(data: bytes, path: str | None) -> Iterator[tuple]:
    """Records of one file, unpacked as they are read; what cannot be read is a last row with an error."""
    import gzip
    import io
    import zlib

    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if line.startswith(b"WARC/") and (found := _record(stream, path)):
                yield found
    except (OSError, EOFError, zlib.error) as e:
        yield ("", None, None, None, None, None, None, path, f"{type(e).__name__}: {e}")


def parse_records(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Response and revisit records of WARC files, plain or gzipped, as captures for :func:`resolve`.

    A record or file that cannot be read is a row with an ``error``; a null content has no records.
    """
    at, named = files.columns.index(content), files.columns.index(path)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.string()]
        names = [x.split(" ")[0] for x in _RECORD.replace("string,string", "").split(", ")]

        def shown(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names)

        for batch in batches:
            for data, name in zip(batch.column(at), batch.column(named)):
                held = []
                for row in _records(data.as_py() or b"", name.as_py()):
                    held.append(row)
                    if len(held) == RECORDS:
                        yield shown(held)
                        held = []
                yield shown(held)

    return files.mapInArrow(run, _RECORD)


def _field(headers: str, name: str) -> Column:
    return F.try_element_at(F.col(headers), F.lit(name))


def merged_headers(stored: Column, renewed: Column) -> Column:
    """Stored fields, replaced and joined by those that a 304 may renew; names are in lower case."""
    allowed = F.map_filter(renewed, lambda k, v: ~k.isin(*KEPT_FIELDS) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(kept), F.map_entries(allowed))))


def resolve(captures: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url key, response_id, verdict, headers, digest, length.

    ``captures``: record_id, url, ts (any orderable type), status, headers (lower-case names), and
    optionally type, digest and length of the payload; a record of the type "revisit" or with status 304 is a
    revisit, one with status 200 otherwise a full response. Payloads are not read: the result names the response that holds them.
    """
    spark = captures.sparkSession
    columns = captures.columns
    typed = F.coalesce(F.col("type") == "revisit", F.lit(False)) if "type" in columns else F.lit(False)
    again = typed | F.coalesce(F.col("status") == 304, F.lit(False))
    rows = captures.where(again | (F.col("status") == 200)).select(
        "record_id", canonical_url(F.col("url")).alias("key"), "ts", (~again).alias("full"), "headers",
        *[F.col(c) if c in columns else F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("length", "long"))],
    )
    lost = rows.where("not full and (key is null or ts is null)")
    rows = rows.where("key is not null and ts is not null")
    kept = F.when(F.col("full"), F.struct("ts", "record_id", "headers", "digest", "length"))
    rows = rows.withColumn("response", kept)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A revisit comes before responses of its own time, which are not earlier.
    dealt = rows.repartitionByRange(parts, "key", "ts", "full", "record_id").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "captures")
    own = Window.partitionBy("part", "key").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last("response", ignorenulls=True).over(own)).where("not full")
    ends = dealt.groupBy("key", "part").agg(F.max_by("response", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("end"))
    borders = ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")  # at most one for each border
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(borders, "key").select("key", "part", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    found = near.join(carried, ["key", "part"], "left").withColumn("r", F.coalesce("near", "carried"))
    etag, stored_etag = _field("headers", "etag"), F.try_element_at(F.col("r.headers"), F.lit("etag"))
    since, stored_since = _field("headers", "last-modified"), F.try_element_at(F.col("r.headers"), F.lit("last-modified"))
    bare = lambda x: F.regexp_replace(x, "^W/", "")  # noqa: E731  weak comparison
    verdict = (
        F.when(F.col("r").isNull(), "none")
        .when(etag.isNotNull() & stored_etag.isNotNull(), F.when(bare(etag) == bare(stored_etag), "resolved").otherwise("mismatch"))
        .when(since.isNotNull() & stored_since.isNotNull(), F.when(since == stored_since, "resolved").otherwise("mismatch"))
        .when(etag.isNotNull() | since.isNotNull(), "mismatch")
        .otherwise("unchecked")
    )
    found = found.withColumn("verdict", verdict)
    taken = F.col("verdict").isin("resolved", "unchecked")
    known = found.select(
        "record_id", "key",
        F.when(taken, F.col("r.record_id")).alias("response_id"),
        "verdict",
        F.when(taken, merged_headers(F.coalesce("r.headers", F.create_map().cast("map<string,string>")), F.coalesce("headers", F.create_map().cast("map<string,string>")))).alias("headers"),
        F.when(taken, F.col("r.digest")).alias("digest"),
        F.when(taken, F.col("r.length")).alias("length"),
    )
    none = lost.select(
        "record_id", "key", F.lit(None).cast(known.schema["response_id"].dataType).alias("response_id"), F.lit("none").alias("verdict"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"),
    )
    return known.unionByName(none)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log from a table of pages: each page is fetched once, and asked for again after a later page.

    Page p is a full response at time 2p. Its revisit comes at time 2p + 5, under the same URL, with the
    page's entity tag; every third one lacks it and gives the date instead, and every seventh one's is foreign.
    """
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length("html").cast("long").alias("length"))
    date = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    first = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-length"), F.col("length").cast("string"), F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"), "digest", "length",
    )
    asked = F.when(F.col("page_id") % 7 == 0, F.lit('"foreign"')).when(F.col("page_id") % 3 == 0, F.lit(None).cast("string")).otherwise(tag)
    again = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 2 + 5).alias("ts"), F.lit(304).alias("status"),
        F.map_filter(
            F.create_map(
                F.lit("etag"), asked, F.lit("last-modified"), date, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"),
            ), lambda k, v: v.isNotNull(),
        ).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"),
    )
    return first.unionByName(again)
