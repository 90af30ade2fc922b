"""WARC archives: writing with revisits and continuation records, and segment reassembly.

Writing.  A payload becomes an HTTP response in chunked transfer framing.  A block longer than
``segment_bytes`` is cut into a first record (WARC-Segment-Number 1) and continuation records that
name it in WARC-Segment-Origin-ID; the last one states WARC-Segment-Total-Length.  Of equal payloads
of at least ``revisit_bytes``, the one with the largest id is stored and the others are revisit
records without a body.  Spark's text writer stores the records, a record's closing blank lines as
its line separator, so archives can lie in any store that Spark reaches; whole files are gzipped.

A record's id holds the page's id, the payload's digest and the number of the row among those that
have both in common, so that every row has its own, and a revisit can name the record it means.

Reading.  Each archive is parsed by its Content-Length fields.  Records in one piece are finished at
once; pieces of segmented ones are grouped by origin, ordered by number and checked against the
total length.  Then the chunked framing is decoded, and revisits take length and digest from the
record they name.  ``read_pages`` parses an archive once: what lies whole in it is finished in the
same task, and only pieces of origins that it holds in part are grouped with those of others.

Defined results: null payloads are empty responses; repeated ids give repeated records, each a response
or revisit by its own payload; a row without an id is never what a revisit names, is itself a revisit
if a row with an id has its payload, and else a response, and comes back without an id; an origin
with missing pieces, a wrong total or broken framing comes back with ``error`` set and no payload;
pieces of an origin beyond those that ``read_pages`` finished it from are judged by themselves;
extra columns are ignored; an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_dir

CRLF = b"\r\n"
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
REVISIT_BYTES = 1_000
RECORDS_PER_FILE = 2_000
RECORD = "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, segment int, origin string, total_length long, payload_digest string, block binary"
PAGE = "page_id long, record_id string, record_type string, target_uri string, refers_to_id string, segments int, payload binary, payload_bytes long, payload_digest string, error string"
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = []
    for lo in range(0, len(payload), size):
        piece = payload[lo : lo + size]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing; extensions and trailers are allowed, cut framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            if body[at:] != CRLF and not body[at:].endswith(CRLF + CRLF):
                raise ValueError("no end of trailers")
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is cut")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, chunked or plain."""
    head, gap, body = block.partition(CRLF + CRLF)
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record_uri(page_id: int | None, row: str, segment: int = 1) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}:{segment}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def _clean(uri: str | None) -> str:
    return "".join(c for c in uri or "" if c >= " " and c != "\x7f")


def records_of(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, row: int, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without their closing blank lines."""
    common = [("WARC-Target-URI", _clean(uri)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        common.append(("X-Page-ID", str(page_id)))
    me = record_uri(page_id, f"{digest}.{row}")
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_uri(refers_to, f"{digest}.0"))], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, ("Content-Type", "application/http; msgtype=response")], block)]
    out, last = [], (len(block) - 1) // segment_bytes
    for k in range(last + 1):
        fields = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", record_uri(page_id, f"{digest}.{row}", k + 1)), *common, ("WARC-Segment-Number", str(k + 1))]
        if k:
            fields.append(("WARC-Segment-Origin-ID", me))
        if k == last:
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(fields, block[k * segment_bytes : (k + 1) * segment_bytes]))
    return out


def parse(archive: bytes):
    """Yields (fields, block) of each record of an uncompressed archive, by its stated lengths."""
    at, n = 0, len(archive)
    while at < n:
        if archive[at : at + 2] == CRLF:
            at += 2
            continue
        end = archive.find(CRLF + CRLF, at)
        if end < 0 or archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in archive[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields["content-length"])
        yield fields, archive[end + 4 : end + 4 + size]
        at = end + 4 + size


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", path: str | None = None, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Writes the archive of a table of pages and returns its folder."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc/{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("large", F.octet_length("payload") >= revisit_bytes)
    # Only ids and digests are grouped; a group of copies is folded in each task first.
    each = rows.groupBy("page_id", "digest", "large").agg(F.count("*").alias("n"))
    keeper = each.filter("large").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.sum("n").alias("copies")).filter("copies > 1").select("digest", "keeper")
    refers_to = F.when(F.col("large") & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))), F.col("keeper"))
    marks = each.join(keeper, "digest", "left").select(F.col("page_id").alias("m_id"), F.col("digest").alias("m_digest"), refers_to.alias("refers_to"), (F.col("n") > 1).alias("again"))
    marks = cut(marks.filter("refers_to is not null or again"), "warc-marks")
    met = rows.drop("large").join(marks, F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")), "left").drop("m_id", "m_digest")
    number = F.lit(0)
    if marks.filter("again").limit(1).count():
        # Rows that are alone with their id and payload are spread by a key of their own.
        alone = F.when(~F.coalesce("again", F.lit(False)), F.monotonically_increasing_id())
        met = met.withColumn("alone", alone)
        number = F.row_number().over(Window.partitionBy("page_id", "digest", "alone").orderBy("url")) - 1
    rows = met.withColumn("row", number).drop("again", "alone")
    schema = "record binary"

    def frame(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 256):
                out = []
                for r in batch.slice(lo, 256).to_pylist():
                    out += records_of(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["row"], segment_bytes)
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    framed = rows.mapInArrow(frame, schema).select(F.col("record").cast("string").alias("value"))
    framed.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_names(schema))


def _batches(rows, schema: str):
    """Rows in batches of few rows and, but for a row that is longer, few bytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if type(x) is bytes)
        if len(out) == BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _records(data: bytes):
    """The records of one archive, plain or gzipped, as rows of RECORD."""
    import zlib

    if data[:2] == b"\x1f\x8b":
        data = _members(data, zlib)
    for f, block in parse(data):
        whole = "warc-segment-number" not in f
        yield (f["warc-record-id"], f["warc-type"], int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-target-uri"), f.get("warc-refers-to"), None if whole else int(f["warc-segment-number"]), None if whole else f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-payload-digest"), block)


def _page(page_id, record_id, record_type, target_uri, refers_to_id, pieces: list[tuple[int, bytes]], total_length: int | None, keep_payload: bool) -> tuple:
    """A row of PAGE from the ordered pieces of a record."""
    import hashlib

    payload, error = None, None
    if record_type == "response":
        try:
            if [k for k, _ in pieces] != list(range(1, len(pieces) + 1)):
                raise ValueError("segments are missing or repeated")
            block = b"".join(b for _, b in pieces)
            if len(block) != total_length:
                raise ValueError(f"{len(block)} bytes, {total_length} stated")
            payload = http_payload(block)
        except ValueError as e:
            error = str(e)
    elif record_type != "revisit":
        error = "no first segment"
    return page_id, record_id, record_type, target_uri, refers_to_id, len(pieces), payload if keep_payload else None, None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(), error


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _contents(batches):
    for batch in batches:
        for k in range(len(batch)):
            yield batch.column(0)[k].as_py()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder; gzip is seen by its first bytes."""

    def work(batches):
        for data in _contents(batches):
            yield from _batches(_records(data), RECORD)

    return _files(spark, path).mapInArrow(work, RECORD)


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """``reassemble`` of the archives in a folder, each parsed once and the rows kept as a table."""
    schema = f"{PAGE}, segment int, origin string, total_length long, block binary"

    def rows(data):
        held: dict[str, tuple[list[tuple], list[int]]] = {}  # pieces; their bytes and the bytes stated
        for record in _records(data):
            record_id, record_type, page_id, uri, refers_to_id, segment, origin, total, _, block = record
            if segment is None:
                if record_type in ("response", "revisit"):
                    yield *_page(page_id, record_id, record_type, uri, refers_to_id, [(1, block)], len(block), keep_payload), None, None, None, None
                continue
            mine, sizes = held.setdefault(origin, ([], [0, -1]))
            mine.append(record)
            sizes[0] += len(block)
            sizes[1] = max(sizes[1], -1 if total is None else total)
            if sizes[0] == sizes[1] and (done := _response(mine)):
                del held[origin]
                first = done[0]
                yield *_page(first[2], origin, first[1], first[3], None, [(r[5], r[9]) for r in done], sizes[1], keep_payload), None, None, None, None
        for mine, _ in held.values():
            for record_id, record_type, page_id, uri, refers_to_id, segment, origin, total, digest, block in mine:
                yield page_id, record_id, record_type, uri, refers_to_id, None, None, None, digest, None, segment, origin, total, block

    def work(batches):
        for data in _contents(batches):
            yield from _batches(rows(data), schema)

    met = cut(_files(spark, path).mapInArrow(work, schema), "warc-pages", stays=True)
    done = met.filter("segment is null").select(*_names(PAGE))
    return _named(done).unionByName(reassemble(met.filter("segment is not null").select(*_names(RECORD)), keep_payload))


def _response(pieces: list[tuple]) -> list[tuple]:
    """The pieces of a response in order, none if one is missing or repeated."""
    pieces = sorted(pieces, key=lambda r: r[5])
    whole = [r[5] for r in pieces] == list(range(1, len(pieces) + 1)) and pieces[0][1] == "response"
    return pieces if whole else []


def _members(data: bytes, zlib) -> bytes:
    """Every member of a gzip file, one for the whole file or one for each record."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(out)


def reassemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row for each page: (page_id, record_type, target_uri, payload, payload_bytes, payload_digest,
    refers_to, segments, error)."""
    whole = records.filter("segment is null and record_type in ('response', 'revisit')")
    whole = whole.select("page_id", "record_id", "record_type", "target_uri", "refers_to_id", F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("pieces"), F.octet_length("block").cast("long").alias("total_length"))
    # A group holds the pieces of one block, never more.
    first = F.col("segment") == 1
    joined = records.filter("segment is not null").groupBy("origin").agg(
        F.max(F.when(first, F.col("page_id"))).alias("page_id"),
        F.max(F.when(first, F.col("record_type"))).alias("record_type"),
        F.max(F.when(first, F.col("target_uri"))).alias("target_uri"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
        F.max("total_length").alias("total_length"),
    )
    joined = joined.select("page_id", F.col("origin").alias("record_id"), "record_type", "target_uri", F.lit(None).cast("string").alias("refers_to_id"), "pieces", "total_length")

    def rows(batch):
        for lo in range(0, len(batch), BATCH_ROWS):
            for r in batch.slice(lo, BATCH_ROWS).to_pylist():
                pieces = [(p["segment"], p["block"]) for p in r["pieces"]]
                yield _page(r["page_id"], r["record_id"], r["record_type"], r["target_uri"], r["refers_to_id"], pieces, r["total_length"], keep_payload)

    def work(batches):
        for batch in batches:
            yield from _batches(rows(batch), PAGE)

    return _named(whole.unionByName(joined).mapInArrow(work, PAGE))


def _named(pages: DataFrame) -> DataFrame:
    """With the page that a revisit names."""
    return pages.withColumn("refers_to", F.regexp_extract("refers_to_id", r"^<urn:page:(-?\d+):", 1).try_cast("long"))


def resolve(pages: DataFrame) -> DataFrame:
    """Revisits take length and digest from the response they name; a missing one is an error."""
    target = pages.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("t_bytes"), F.col("payload_digest").alias("t_digest"))
    here, away = pages.filter("record_type = 'response' or record_type is null"), pages.filter("record_type = 'revisit'")
    met = away.join(target.dropDuplicates(["refers_to_id"]), "refers_to_id", "left")
    met = met.withColumn("payload_bytes", F.col("t_bytes")).withColumn("payload_digest", F.col("t_digest"))
    met = met.withColumn("error", F.when(F.col("t_bytes").isNull(), F.lit("the record it revisits is missing")))
    return here.unionByName(met.select(here.columns))
