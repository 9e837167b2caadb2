"""WARC records, and resolution of not-modified revisits by an as-of join on the canonical URL.

A revisit (HTTP 304) takes its content from the latest earlier full response (strictly earlier date) of the same canonical
URL. Validators are checked: entity tags by weak comparison where both have one, else Last-Modified, else the payload
digest. Headers are merged: those of the response, replaced by the ones a 304 may update.

The join moves no payloads. Records are range-partitioned by (canonical URL, date), so a URL with a third of all records
spreads over partitions; each partition carries its latest response forward, and what a partition inherits from those
before it is settled by one row for each partition.

Damaged data lose no other record: a torn record or gzip member is passed over and reported, and reading goes on at the next
one. A date that is none, or lies outside of the years that can be told, is null.

Nulls: a null url is canonicalised as an empty one is (/); a record without a date, or with one that is no date, is never
earlier than another and finds nothing.
Ties: of responses with one date the one with the largest record_id is latest. Repeated rows are resolved alike. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import datetime
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, slices, written

#: Headers of a 304 that replace the stored ones.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change the resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|msclkid|ref|phpsessid|jsessionid|sid)(=|$)"
#: The kind of a record that could not be read.
DAMAGED = "damaged"
#: How a gzip member begins.
GZIP = b"\x1f\x8b\x08"
RECORD = "record_id string, kind string, url string, date timestamp, status int, headers map<string,string>, digest string, body binary"
REVISIT = "record_id string, url string, canonical_url string, date timestamp, response_id string, state string, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path, sorted query without tracking parameters; no scheme or fragment."""
    text = F.btrim(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(text, r"#.*$", "")
    rest = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", "")))
    query = F.filter(F.array_sort(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def warc_record(kind: str, record_id: str, url: str, date: str, status: str, headers: dict[str, str], body: bytes, digest: str | None = None) -> bytes:
    """One WARC/1.1 record with an HTTP message as its block."""
    http = f"HTTP/1.1 {status}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + body
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
    if digest:
        lines.append(("WARC-Payload-Digest", digest))
    if kind == "revisit":
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/server-not-modified"))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + http + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a name that comes again has its values joined by a comma, as HTTP has it."""
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def unpacked(data: bytes) -> list[bytes]:
    """WARC data as it is, or its gzip members. Whole members that follow each other are one piece; after a torn or damaged
    one, whose own data up to the damage are a piece, the next member is looked for."""
    if data[:2] != GZIP[:2]:
        return [data]
    pieces, run, at = [], [], 0
    while at >= 0:
        got, end = _member(data, at)
        run.append(got)
        if end is not None and (end == len(data) or data[end : end + 3] == GZIP):
            at = end if end < len(data) else -1
            continue
        pieces.append(b"".join(run))
        run = []
        at = data.find(GZIP, at + 1 if end is None else end)
    return [p for p in [*pieces, b"".join(run)] if p]


def _member(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int | None]:
    """What the gzip member that begins here holds (up to its damage), and where it ends; None if it does not."""
    member, out = zlib.decompressobj(31), []
    try:
        for k in range(at, len(data), step):
            out.append(member.decompress(data[k : k + step]))
            if member.eof:
                return b"".join(out), min(k + step, len(data)) - len(member.unused_data)
    except zlib.error:
        pass
    return b"".join(out), None


def date_of(text: str | None) -> datetime.datetime | None:
    """A WARC date in UTC; null where it is none."""
    try:
        date = datetime.datetime.fromisoformat((text or "").replace("Z", "+00:00"))
        return date.replace(tzinfo=datetime.UTC) if date.tzinfo is None else date.astimezone(datetime.UTC)
    except (ValueError, OverflowError):
        return None


def read_records(data: bytes):
    """Record by record: (record_id, kind, url, date, status, HTTP headers, digest, body).

    A record whose length is no number, or is larger than what follows, is passed over up to the next record head that
    begins a line; it comes out as one of kind DAMAGED with its named fields and no body. A file that was torn within its
    last record ends with such a one."""
    for piece in unpacked(data):
        yield from _records(piece)


def _records(data: bytes):
    at = 0
    while True:
        at = data.find(b"WARC/1.", at)
        if at < 0:
            return
        if at and data[at - 1 : at] != b"\n":
            at += 7
            continue
        end = data.find(b"\r\n\r\n", at)
        warc = _fields(data[at : end if end >= 0 else len(data)])
        named = warc.get("warc-record-id", "").strip("<>"), warc.get("warc-type"), warc.get("warc-target-uri"), warc.get("warc-date")
        length = warc.get("content-length", "")
        known = length.isascii() and length.isdigit() and len(length.lstrip("0")) < 16
        size = int(length.lstrip("0") or 0) if known else 0
        if end < 0 or not known or end + 4 + size > len(data):
            yield named[0], DAMAGED, named[2], named[3], None, {}, warc.get("warc-payload-digest"), None
            at += 7
            continue
        block = data[end + 4 : end + 4 + size]
        head, _, body = block.partition(b"\r\n\r\n")
        status = head.split(b"\r\n", 1)[0].split(b" ")
        yield *named, int(status[1]) if len(status) > 1 and len(status[1]) == 3 and status[1].isdigit() else None, _fields(head), warc.get("warc-payload-digest"), body
        at = end + 4 + size


def _parsed(batches):
    for rows in batches:
        for part in slices(rows, 0, 8 << 20):
            got = [r for data in part.column(0).to_pylist() if data for r in read_records(data)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in got], pa.string()), pa.array([r[1] for r in got], pa.string()), pa.array([r[2] for r in got], pa.string()), pa.array([date_of(r[3]) for r in got], pa.timestamp("us", "UTC")), pa.array([r[4] for r in got], pa.int32()), pa.array([list(r[5].items()) for r in got], pa.map_(pa.string(), pa.string())), pa.array([r[6] for r in got], pa.string()), pa.array([r[7] for r in got], pa.binary())],
                names=["record_id", "kind", "url", "date", "status", "headers", "digest", "body"],
            )


def parse_warc(files: DataFrame, content_col: str = "content") -> DataFrame:
    """RECORD rows of WARC data, plain or of gzip members, one binary value for each run of whole records."""
    return files.select(F.col(content_col).alias("content")).mapInArrow(_parsed, RECORD)


FILLED = "part int, canonical_url string, revisit boolean, tail boolean, record_id string, url string, date timestamp, headers map<string,string>, digest string, response_id string, response_headers map<string,string>, response_digest string, waits boolean"


def _filled(batches):
    """Sorted records: each revisit with the latest response before it in this partition; the tail row has the last one."""
    part = TaskContext.get().partitionId()
    latest, latest_url, first_url, last_url = None, None, None, None
    out_schema = pa.schema([("part", pa.int32()), ("canonical_url", pa.string()), ("revisit", pa.bool_()), ("tail", pa.bool_()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.timestamp("us", "UTC")), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("response_id", pa.string()), ("response_headers", pa.map_(pa.string(), pa.string())), ("response_digest", pa.string()), ("waits", pa.bool_())])
    for rows in batches:
        out = []
        for r in rows.to_pylist():
            url = r["canonical_url"]
            first_url = url if first_url is None else first_url
            last_url = url
            if r["kind"] == "response":
                if r["date"] is not None:
                    latest, latest_url = r, url
                continue
            mine = latest if latest is not None and latest_url == url and r["date"] is not None else None
            out.append({"part": part, "canonical_url": url, "revisit": True, "tail": False, "record_id": r["record_id"], "url": r["url"], "date": r["date"], "headers": r["headers"], "digest": r["digest"], "response_id": mine and mine["record_id"], "response_headers": mine and mine["headers"], "response_digest": mine and mine["digest"], "waits": mine is None and url == first_url and r["date"] is not None})
        yield pa.RecordBatch.from_pylist(out, out_schema)
    if last_url is not None:
        own = latest if latest_url == last_url else None
        yield pa.RecordBatch.from_pylist([{"part": part, "canonical_url": last_url, "revisit": False, "tail": True, "response_id": own and own["record_id"], "response_headers": own and own["headers"], "response_digest": own and own["digest"], "waits": last_url == first_url}], out_schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """REVISIT rows of all revisits. state: resolved, no-earlier-response, validator-mismatch or no-validator."""
    spark = records.sparkSession
    meta = records.where(F.col("kind").isin("response", "revisit") & ((F.col("kind") == "revisit") | (F.col("status") == 200)))
    meta = meta.select(canonical_url(F.col("url")).alias("canonical_url"), "date", (F.col("kind") == "response").alias("late"), "record_id", "kind", "url", "headers", "digest")
    meta, meta_path = written(meta, "records")  # range partitioning reads its input twice
    keys = ["canonical_url", "date", "late", "record_id"]
    placed = meta.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table, _ = written(placed.mapInArrow(_filled, FILLED), "revisits")
    drop_scratch(spark, meta_path)
    tails = sorted(table.where("tail").select("part", "canonical_url", "response_id", "response_headers", "response_digest", "waits").collect(), key=lambda r: r.part)
    carried, last = [], None  # what each partition inherits: the latest response of the URL that its predecessor ends with
    for t in tails:
        if last is not None and last["response_id"] is not None:
            carried.append((t.part, last["canonical_url"], last["response_id"], last["response_headers"], last["response_digest"]))
        own = {"canonical_url": t.canonical_url, "response_id": t.response_id, "response_headers": t.response_headers, "response_digest": t.response_digest}
        goes_on = t.response_id is None and t.waits and last is not None and last["canonical_url"] == t.canonical_url
        last = last if goes_on else own
    carry = spark.createDataFrame(carried, "c_part int, c_url string, c_id string, c_headers map<string,string>, c_digest string")
    both = table.where("revisit").join(F.broadcast(carry), (F.col("part") == F.col("c_part")) & (F.col("canonical_url") == F.col("c_url")) & F.col("waits"), "left")
    old, new = F.coalesce("response_headers", "c_headers"), F.col("headers")
    rid, rdigest = F.coalesce("response_id", "c_id"), F.coalesce("response_digest", "c_digest")
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    etag_a, etag_b, lm_a, lm_b = old["etag"], new["etag"], old["last-modified"], new["last-modified"]
    state = (
        F.when(rid.isNull(), "no-earlier-response")
        .when(etag_a.isNotNull() & etag_b.isNotNull(), F.when(strong(etag_a) == strong(etag_b), "resolved").otherwise("validator-mismatch"))
        .when(lm_a.isNotNull() & lm_b.isNotNull(), F.when(lm_a == lm_b, "resolved").otherwise("validator-mismatch"))
        .when(rdigest.isNotNull() & F.col("digest").isNotNull(), F.when(rdigest == F.col("digest"), "resolved").otherwise("validator-mismatch"))
        .otherwise("no-validator")
    )
    update = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*UPDATES))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    merged = F.when(state == "resolved", F.map_concat(kept, update))
    return both.select("record_id", "url", "canonical_url", "date", rid.alias("response_id"), state.alias("state"), merged.alias("headers"), rdigest.alias("digest"))


def _crawl(batches):
    """A small crawl of each page: full responses, each with validators of its own, and revisits before, between and after
    them whose URL and validators are written differently."""
    import hashlib

    zero = datetime.datetime(2024, 1, 1)
    stamp = lambda k: (zero + datetime.timedelta(seconds=k)).strftime("%Y-%m-%dT%H:%M:%SZ")
    for rows in batches:
        for part in slices(rows, 2, 8 << 20):
            out = []
            for page_id, url, page in zip(*(part.column(k).to_pylist() for k in range(3))):
                body, k, url = (page or "").encode("utf-8", "surrogatepass"), page_id or 0, url or ""
                digest = "sha1:" + hashlib.sha1(body).hexdigest()
                data = b""
                for n in range(1 + k % 3):  # responses a day apart, revisits half a day after each
                    tag = f'"{digest[5:21]}-{n}"'
                    at = 60 * k + 86_400 * n
                    head = {"Content-Type": "text/html", "ETag": tag, "Date": stamp(at), "Cache-Control": "max-age=60"}
                    again = {"Date": stamp(at + 43_200), "Cache-Control": "max-age=3600", "Content-Type": "text/plain"}
                    if k % 7:
                        again["ETag"] = "W/" + tag if (k + n) % 5 else '"changed"'
                    data += warc_record("response", f"urn:page:{k}:{n}:0", url, stamp(at), "200 OK", head, body, digest)
                    data += warc_record("revisit", f"urn:page:{k}:{n}:1", url + ("#again" if k % 2 else ""), stamp(at + 43_200), "304 Not Modified", again, b"", digest if k % 3 else None)
                if k % 11 == 0:
                    data += warc_record("revisit", f"urn:page:{k}:early", url, stamp(60 * k - 60), "304 Not Modified", {}, b"", digest)
                out.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])


def crawl_of(pages: DataFrame) -> DataFrame:
    """WARC data (content binary) of page_id, url, html."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_crawl, "content binary")
