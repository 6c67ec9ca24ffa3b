"""WARC archives: writing pages with revisits and segments, reading them back whole.

The writer makes records with DataFrame functions and lets Spark's text sink write them, gzipped, a
record's closing line feeds being the sink's separator. The reader takes archive files as bytes, cuts
records by their Content-Length, puts segmented records together (continuations grouped by the id of the
record they continue, ordered by segment number, checked against the total length) and decodes the HTTP
body's chunked framing.
"""

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from highmark.llm._shared import numbered, stored

#: Block bytes of a segment, body bytes of a chunk, records of a file (so a file has 64 MB at most, unpacked).
SEGMENT, CHUNK, RECORDS = 32_768, 8_192, 2_000
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, type string, page_id long, digest string, refers_to string, origin_id string, segment long, total long, block binary, problem string"
_PAYLOAD = "record_id string, type string, page_id long, digest string, refers_to string, payload binary, problem string"


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _id(row: Column, segment: Column | None = None) -> Column:
    whole = F.concat(F.lit("<urn:highmark:page:"), row.cast("string"))
    return F.concat(whole, F.lit(">")) if segment is None else F.concat(whole, F.lit(":"), segment.cast("string"), F.lit(">"))


def _framed(payload: Column) -> Column:
    """Chunked framing; bytes are kept in strings, which Spark joins as they are."""
    n = F.length(payload)
    chunk = lambda i: F.substring(payload, i * CHUNK + 1, F.lit(CHUNK))
    framed = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / CHUNK) - 1, F.lit(0)).cast("int")),
        lambda i: F.when(n > 0, F.concat(F.lower(F.hex(F.length(chunk(i)))), F.lit("\r\n"), chunk(i).cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
    )
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def records(pages: DataFrame, segment: int = SEGMENT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A string `value` per WARC record of pages(page_id, url, html), without the line feeds that close it.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, the one with the smallest page_id (null
    last, then the first row) is a response and the others revisit it. A null html is an empty payload;
    a null page_id or url has no header line. Rows that repeat have records of their own; no page gives no record.
    pages(row, ...) are numbered rows (numbered()): only numbers and digests meet by payload.
    """
    rows = pages.select("row", F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    digests = stored(rows.filter(F.length("payload") >= LEAST_REVISIT).select("row", "page_id", "digest"), "digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = digests.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.filter("n > 1").select("digest", F.col("first.row").alias("first_row")), "firsts")
    again = stored(digests.join(firsts, "digest").filter("row <> first_row").select("row", "first_row"), "again")
    rows = rows.join(again, "row", "left").withColumn("again", F.col("first_row").isNotNull())
    rows = rows.withColumn("block", F.when(F.col("again"), F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), _framed(F.col("payload")))).cast("binary"))
    rows = rows.withColumn("total", F.length("block")).withColumn("segments", F.ceil(F.col("total") / segment).cast("int"))
    parts = rows.select("row", "page_id", "url", "digest", "first_row", "again", "block", "total", "segments", F.explode(F.sequence(F.lit(1), F.col("segments"))).alias("part"))
    own = F.substring("block", (F.col("part") - 1) * segment + 1, F.lit(segment))
    several, begins = F.col("segments") > 1, F.col("part") == 1
    kind = F.when(~begins, "continuation").when(F.col("again"), "revisit").otherwise("response")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(begins, _id(F.col("row"))).otherwise(_id(F.col("row"), F.col("part")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Page-ID", F.when(begins, F.col("page_id"))),
        _line("WARC-Payload-Digest", F.when(begins, F.concat(F.lit("sha256:"), F.col("digest")))),
        _line("WARC-Profile", F.when(begins & F.col("again"), F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(begins & F.col("again"), _id(F.col("first_row")))),
        _line("WARC-Segment-Number", F.when(several, F.col("part"))),
        _line("WARC-Segment-Origin-ID", F.when(~begins, _id(F.col("row")))),
        _line("WARC-Segment-Total-Length", F.when(several & (F.col("part") == F.col("segments")), F.col("total"))),
        _line("Content-Type", F.when(begins, F.lit("application/http;msgtype=response"))),
        _line("Content-Length", F.length(own)),
        F.lit("\r\n"),
    )
    return parts.select(F.concat(head, own.cast("string")).alias("value"))


def write(pages: DataFrame, folder: str, segment: int = SEGMENT) -> None:
    """Writes the records of pages(page_id, url, html) as gzipped archives of at most RECORDS records to folder. Any rows do: see records()."""
    pages = numbered(pages.select("page_id", "url", "html"), "row")
    records(pages, segment).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Header fields (names in lower case), block and problem of each record of an archive that comes in pieces.

    What isn't a record, or has no readable length, is told as "header" once, and reading goes on at the next
    line feeds with a record behind them. A record that breaks off, or an archive that can't be unpacked any further, is told as "truncated".
    """
    held, at, damaged = bytearray(), 0, False

    def more() -> bool:
        nonlocal at, damaged
        if at > 1 << 20:
            del held[:at]
            at = 0
        try:
            new = next(pieces, None)
        except zlib.error:
            new, damaged = None, True
        held.extend(new or b"")
        return new is not None

    def found(mark: bytes) -> int:
        """How far from here a mark begins, -1 without any."""
        looked = 0
        while (place := held.find(mark, at + looked)) < 0:
            looked = max(0, len(held) - at - len(mark) + 1)
            if not more():
                return -1
        return place - at

    while True:
        while at < len(held) and held[at] in b"\r\n":
            at += 1
        if at == len(held):
            if more():
                continue
            if damaged:
                yield {}, None, "truncated"
            return
        n = found(b"\r\n\r\n")
        if n < 0 and bytes(held[at : at + 5]) == b"WARC/":
            yield {}, None, "truncated"
            return
        lines = bytes(held[at : at + max(n, 0)]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
            yield {}, None, "header"
            n = found(b"\r\n\r\nWARC/")
            if n < 0:
                return
            at += n
            continue
        at += n + 4
        size = int(fields["content-length"])
        while len(held) - at < size:
            if not more():
                yield fields, None, "truncated"
                return
        yield fields, bytes(held[at : at + size]), None
        at += size


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """The bytes of an archive a megabyte at a time, through all its gzip members; zlib.error where they are damaged or break off."""
    if raw[:2] != b"\x1f\x8b":
        for at in range(0, len(raw), 1 << 20):
            yield raw[at : at + (1 << 20)]
        return
    rest = memoryview(raw)
    while len(rest):
        member = zlib.decompressobj(31)
        while not member.eof:
            if not len(rest):
                yield member.flush()
                if member.eof:
                    break
                raise zlib.error("a member breaks off")
            taken, rest = rest[: 1 << 16], rest[1 << 16 :]
            while len(taken) and not member.eof:
                yield member.decompress(taken, 1 << 20)
                taken = member.unconsumed_tail
        rest = memoryview(raw)[len(raw) - len(rest) - len(member.unused_data) :]
        while len(rest) and rest[0] == 0:  # padding
            rest = rest[1:]


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in folder, segments not yet put together.

    Header names are read in any case of letters; ids and lengths that are no number are null. What can't
    be read is a row with nothing but a `problem` ("header" or "truncated"), and the archive's other records stay. An
    archive passes through one task whole, so a file should have some hundred MB at most (written ones have 64).
    """
    names = ("warc-record-id", "warc-type", "warc-page-id", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")
    numbers = {"warc-page-id", "warc-segment-number", "warc-segment-total-length"}
    schema = pa.schema(
        [("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin_id", pa.string()), ("segment", pa.int64()), ("total", pa.int64())]
        + [("block", pa.binary()), ("problem", pa.string())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for b in batches:
            for raw in b.column(0):
                rows: list[list] = []
                held = 0
                for fields, block, problem in _parse(_unpacked(raw.as_py())):
                    rows.append([*(_number(fields.get(k)) if k in numbers else fields.get(k) for k in names), block, problem])
                    held += len(block or b"")
                    if held > 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(parse, _RECORD)


def reassemble(parts: DataFrame) -> DataFrame:
    """Whole records of read_records(): those that have segments get their blocks joined.

    `problem` is null where all is well: segments numbered 1 to n (a segment found twice with the same
    bytes counts once), as long together as the last one says. Otherwise it is "segments" or "length",
    and the block is null. Records without a segment number are whole as they are, with the problem that they have, and aren't shuffled.
    Segments without any id are put together; they can't be told apart.
    """
    kept = ["record_id", "type", "page_id", "digest", "refers_to"]
    whole = parts.filter("segment is null").select(*kept, "block", "problem")
    groups = parts.filter("segment is not null").groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
    joined = groups.agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.max("problem").alias("broken"), F.min_by(F.struct("type", "page_id", "digest", "refers_to"), "segment").alias("first")
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.length(p["block"]))
    problem = F.when(F.col("broken").isNotNull(), F.col("broken")).when((numbers != F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))) | F.col("total").isNull(), "segments").when(length != F.col("total"), "length")
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    joined = joined.withColumn("problem", problem).select("record_id", "first.type", "first.page_id", "first.digest", "first.refers_to", F.when(F.col("problem").isNull(), block).alias("block"), "problem")
    return whole.unionByName(joined)


def dechunk(body: bytes) -> bytes | None:
    """The bytes within chunked framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > 0 else -1
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payloads(whole: DataFrame) -> DataFrame:
    """Records of reassemble() with the decoded HTTP body as payload, null where there is a problem ("framing" for a broken body)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, problems = [], []
            for block, kind, problem in zip(b.column(5), b.column(1).to_pylist(), b.column(6).to_pylist(), strict=True):
                head, _, body = (block.as_py() or b"").partition(b"\r\n\r\n")
                if kind == "response" and b"transfer-encoding: chunked" in head.lower():
                    body = dechunk(body)
                bodies.append(None if problem or kind == "revisit" else body)
                problems.append(problem or ("framing" if body is None else None))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bodies, pa.binary()), pa.array(problems, pa.string())], ["record_id", "type", "page_id", "digest", "refers_to", "payload", "problem"])

    return whole.mapInArrow(decode, _PAYLOAD)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page record of the archives in folder: record_id, type, page_id, digest, refers_to, payload, problem.

    A null page_id is one that the record doesn't give; records that repeat are rows each; revisits have a null
    payload, as have records with a problem. A folder without records gives no row.
    """
    return payloads(reassemble(read_records(spark, folder)))
