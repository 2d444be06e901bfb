"""WARC archives: writing pages as segmented records, and reading them back.

Writing: a page is a response record whose block is an HTTP message with chunked transfer framing. Of pages with equal
payloads of at least `least_bytes`, the one with the smallest id is the response and the others are revisits that refer to it.
A block of over `segment_bytes` is cut: the first segment is the record itself, the others are continuation records that name
it by WARC-Segment-Origin-ID; the last one has the total length. A record's id is made of its page's id and payload digest, so a
revisit knows that of its response; what repeats a page's row has a number after it. Each record is a gzip member of its own, so
a reader can begin at any record's offset. Spark's text sink writes the files, with an empty member as its line end, so they can
be in any store that Spark writes to, and a lost task leaves no half file; a file holds FILE_ROWS runs of about ROW_BYTES.

Reading: files are parsed one at a time, inflated piece by piece; segments are grouped by origin identifier, ordered by segment
number, checked against the total length and joined; the chunked framing is decoded and the payload held against its recorded
digest. Records arrive from any file in any order. A record with a missing segment or a wrong length has a reason in `problem`
and no payload. A revisit's page and length are those of the response that it refers to (follow()).

Cases: a null payload is empty; empty payloads and those under `least_bytes` are responses; pages with one id and equal payloads
are all responses if that id is the smallest; ids may be of any type and hold any characters; a null id is never the smallest,
and where there is no other id all are responses; repeated rows are written and read once each; payloads of any length are
written and read whole; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomweave.llm.common import join_many_to_one, map_batches, materialize, new_path

#: Most bytes of a block in one record.
SEGMENT_BYTES = 65_536
#: Bytes of one chunk of the transfer framing.
CHUNK_BYTES = 4_096
#: Bytes of gzip members that are written as one row of the text sink, about, and such rows of a file.
ROW_BYTES, FILE_ROWS = 4 << 20, 16
#: Bytes of a file that are taken at once: little more than a member, since what is left of them after it is copied.
TAKEN_BYTES = 16 << 10
#: Shares of the rows with one payload that are joined apart.
SALTS = 16
SEPARATOR = b"\r\n\r\n"
#: An empty gzip member, without a time: what Spark puts after each row.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "record_id string, number int, type string, page string, refers_to string, digest string, total long, deflated binary"


class BadRecord(ValueError):
    """A record that doesn't hold what it says."""


def chunked(payload: bytes) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [payload[at : at + CHUNK_BYTES] for at in range(0, len(payload), CHUNK_BYTES)]
    return b"".join([*(b"%x\r\n%s\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise BadRecord("a chunk's size line doesn't end")
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise BadRecord("a chunk's size isn't hexadecimal")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        at = end + 2
        if body[at + n : at + n + 2] != b"\r\n":
            raise BadRecord("a chunk's length isn't as its size line says")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, record_id: str, block: bytes, headers: dict[str, object]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **headers, "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block


def _one_line(text: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_id(page: str | None, digest: str, row: int | None = None) -> str:
    """The id of a page's record; row tells repeated pages of one payload apart."""
    own = "urn:nopage" if page is None else f"urn:page:{quote(page, safe='')}"
    return f"<{own}:{digest}{'' if row is None else f':{row}'}>"


def page_of(record: str | None) -> str | None:
    """The page that a record's id names."""
    m = re.match(r"<urn:page:([^:>]*):", record or "")
    return unquote(m[1]) if m else None


def member(record: bytes) -> bytes:
    """A record with its separator as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record + SEPARATOR) + z.flush()


def page_records(page: str | None, row: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without their separators."""
    own = record_id(page, digest, row)
    about = {"WARC-Target-URI": _one_line(url), "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", own, head, about | {"WARC-Profile": profile, "WARC-Refers-To": record_id(refers_to, digest), "Content-Type": "application/http; msgtype=response"})
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    about["Content-Type"] = "application/http; msgtype=response"
    yield _record("response", own, parts[0], about | ({"WARC-Segment-Number": 1} if len(parts) > 1 else {}))
    for k, part in enumerate(parts[1:], 2):
        headers: dict[str, object] = {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k}
        if k == len(parts):
            headers["WARC-Segment-Total-Length"] = len(block)
        yield _record("continuation", f"{own[:-1]}:{k}>", part, headers)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages as gzipped WARC files under path.

    Smallest ids by payload digest are found with a partial aggregate, and joined to ids and digests alone by digest and salt,
    so that the rows of a payload that many pages share are spread. What is a revisit is a written table, joined to the pages by
    id: Spark broadcasts it where its size is known to be small, and else shuffles the payloads once, by a key that isn't hot.
    Rows that repeat a page's id are written once more, so that each has a number that stays.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.octet_length("payload") >= least_bytes).select("page", "digest").withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    shared = narrow.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = narrow.join(salted, ["digest", "salt"]).where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("again"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct()
    revisits = materialize(again, "revisits")
    repeated = materialize(rows.groupBy("page").count().where("count > 1").select(F.col("page").alias("repeated")), "repeated")
    if not repeated.isEmpty():
        is_repeated = F.col("page").eqNullSafe(F.col("repeated"))
        several = materialize(rows.join(repeated, is_repeated, "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-pages")
        heads = several.where("page is not null").groupBy("page", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("head"))
        told = several.join(heads, "row", "left").withColumn("row", F.when(F.col("head"), None).otherwise(F.col("row"))).drop("head")
        rows = rows.join(repeated, is_repeated, "left_anti").withColumn("row", F.lit(None).cast("long")).unionByName(told.select(*rows.columns, "row"))
    else:
        rows = rows.withColumn("row", F.lit(None).cast("long"))
    found = rows.join(revisits, F.col("page").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for values in zip(*columns, strict=True):
                for record in page_records(*(v.as_py() for v in values), segment_bytes):
                    held.append(member(record))
                    size += len(held[-1])
                    if size >= ROW_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    chosen = found.select(F.col("page").cast("string"), "row", "url", "payload", "digest", F.col("refers_to").cast("string"))
    text = map_batches(chosen, run, "members binary").select(F.col("members").cast("string").alias("value"))  # the cast keeps the bytes as they are
    out = text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none")
    out.option("maxRecordsPerFile", FILE_ROWS).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """An archive file's bytes piece by piece, inflated if they are gzip members."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield from (view[at : at + TAKEN_BYTES] for at in range(0, len(view), TAKEN_BYTES))
        return
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            part = view[at : at + TAKEN_BYTES]
            if not part:
                raise BadRecord("a gzip member is cut short")
            out = z.decompress(part)
            at += len(part) - len(z.unused_data)
            if out:
                yield out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file, gzipped as a whole, by record or not."""
    parts, held = _inflated(data), bytearray()

    def until(n: int) -> bool:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    at = 0  # of the record in the inflated file
    while until(1):
        end = held.find(SEPARATOR)
        while end < 0 and until(len(held) + 1):
            end = held.find(SEPARATOR)
        if end < 0 or not held.startswith(b"WARC/"):
            raise BadRecord(f"no record begins at byte {at}")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(headers["content-length"])
        if not until(start + n + 4):
            raise BadRecord(f"the record at byte {at} is cut short")
        yield headers, bytes(held[start : start + n])
        del held[: start + n + 4]
        at += start + n + 4


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path as a row; a continuation has the id of the record that it continues.

    Blocks are deflated, since they are shuffled next.
    """

    def rows(data: bytes) -> Iterator[dict[str, object]]:
        for h, block in parse(data):
            number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
            yield {
                "record_id": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "number": int(number) if number else 0, "type": h.get("warc-type"),
                "page": page_of(h.get("warc-record-id")), "refers_to": h.get("warc-refers-to"),
                "digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None, "total": int(total) if total else None, "deflated": zlib.compress(block, 1),
            }

    schema = pa.schema([("record_id", pa.string()), ("number", pa.int32()), ("type", pa.string()), ("page", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("total", pa.int64()), ("deflated", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for row in rows(data.as_py()):
                    held.append(row)
                    size += len(row["deflated"])
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), run, RECORD_SCHEMA)


def payload_of(kind: str, total: int | None, segments: list[tuple[int, bytes]]) -> tuple[int | None, bytes | None]:
    """Length and payload of a record from its segments (number, block); a revisit has neither."""
    numbers = [n for n, _ in segments]
    block = b"".join(b for _, b in segments)
    if len(segments) > 1 or numbers[0] > 0:
        if numbers != [*range(1, len(numbers) + 1)] or total is None:
            raise BadRecord("a segment is missing")
        if total != len(block):
            raise BadRecord(f"{len(block)} bytes of {total}")
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise BadRecord("the HTTP header doesn't end")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        return None, None
    payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    return len(payload), payload


def reassemble(found: DataFrame) -> DataFrame:
    """One row a record from rows as records() gives them: record_id, page, type, refers_to (a record id), length, digest, payload, problem.

    Segments meet by origin identifier; a group holds the segments of one record. A segment that occurs twice counts once.
    """
    segment = F.struct("number", "deflated")
    whole = found.groupBy("record_id").agg(
        F.max(F.when(F.col("type") != "continuation", F.struct("type", "page", "refers_to", "digest"))).alias("own"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(segment)).alias("segments"),
    ).select("record_id", "own.*", "total", "segments")
    schema = pa.schema([("record_id", pa.string()), ("page", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("length", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])

    def row(record: str | None, type: str | None, page: str | None, refers_to: str | None, digest: str | None, total: int | None, segments: list[dict]) -> dict[str, object]:
        out = {"record_id": record, "page": page, "type": type, "refers_to": refers_to, "digest": digest, "length": None, "payload": None, "problem": None}
        try:
            if type is None:
                raise BadRecord("the record that segments continue is missing")
            n, payload = payload_of(type, total, [(s["number"], zlib.decompress(s["deflated"])) for s in segments])
            own = digest if payload is None else hashlib.sha256(payload).hexdigest()
            if digest and own != digest:
                raise BadRecord("the payload isn't that of the recorded digest")
            return out | {"length": n, "digest": own, "payload": payload}
        except (BadRecord, KeyError, ValueError, zlib.error) as e:
            return out | {"problem": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for values in zip(*batch.columns, strict=True):
                held.append(row(*(v.as_py() for v in values)))
                size += len(held[-1]["payload"] or b"")
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema)

    return map_batches(whole, run, "record_id string, page string, type string, refers_to string, length long, digest string, payload binary, problem string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path, whole: record_id, page, type, refers_to, length, digest, payload, problem."""
    return reassemble(records(spark, path))


def follow(found: DataFrame) -> DataFrame:
    """Records, without payloads, whose revisits are read through their response: its page in refers_to, its length, its digest.

    A response that many revisits refer to has one narrow row, which is broadcast if it is among the most frequent. A revisit
    without its response, or of another digest, has a problem.
    """
    found = materialize(found.drop("payload"), "records")
    revisits, names = found.where("type = 'revisit'"), ["page", "length", "digest", "problem"]
    wanted = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    there = found.where("type = 'response'").select(F.col("record_id").alias("refers_to"), *(F.col(c).alias(f"its_{c}") for c in names))
    targets = materialize(wanted.join(there.withColumn("found", F.lit(True)), "refers_to", "left"), "targets")
    joined = join_many_to_one(revisits, "refers_to", targets)
    trouble = F.when(F.col("found").isNull(), "the response is missing").when(F.col("its_problem").isNotNull(), F.concat(F.lit("of the response: "), "its_problem")).when(F.col("digest") != F.col("its_digest"), "the response has another digest")
    whole = joined.withColumn("problem", F.coalesce("problem", trouble)).withColumn("length", F.when(F.col("problem").isNull(), F.col("its_length"))).withColumn("refers_to", F.col("its_page"))
    return found.where("type is null or type <> 'revisit'").unionByName(whole.select(*found.columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages to the shared folder as WARC files and read them back, revisits through their response; the page's id has its type again."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, least_bytes, segment_bytes)
    kind = pages.schema[id_col].dataType
    return follow(read(pages.sparkSession, path)).withColumn("page", F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
