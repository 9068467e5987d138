"""WARC archives: a writer with identical-payload revisits and a salvage reader.

The writer is a Spark text sink (records end in two CRLFs, which serves as the line
separator), so it works on every file system that Spark can write and is committed
like any other Spark output. The reader takes whole files, plain or of gzip members.
It checks every record (version line, headers, lengths, end mark, block digest).
Where a check fails it searches for the next gzip member or version line from which
a record passes, carries on there, and logs the bytes between as a quarantined gap.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import discard, scratch_path, stage

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
MARK = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
END = b"\r\n\r\n"
#: An archive's bytes, about; and the most that a record may have, which is what a row can hold.
FILE_BYTES, RECORD_BYTES = 1 << 28, (1 << 31) - 1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ROW = "kind string, path string, start long, stop long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in ROW.split(", "))])


# ---- writing


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column, in the JVM: five hex digits make four letters."""
    digest = F.sha1(content)
    letters = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*letters)


def classify(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least_bytes: int = 0) -> tuple[DataFrame, int]:
    """The digest and the id of its response, for each digest of more than one row (a staged table), and the bytes of the largest page.

    Of rows with equal payloads of at least least_bytes bytes the largest id is the
    response. The rows are counted on each partition first, so a payload that a third
    of all rows share is no hot key here. Payloads that occur once need no entry, so
    the table is small where few pages repeat, and the pages then need no shuffle.
    """
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    light = pages.select(F.col(id_col).alias("id"), base32_sha1(F.coalesce(payload_col, F.lit(""))).alias("digest"), size(payload_col).alias("n"), size(url_col).alias("u"))
    seen = Observation()
    light = light.observe(seen, F.max(F.col("n") + F.col("u")).alias("most"))
    heads = light.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return stage(heads, "warc-responses"), seen.get.get("most") or 0


def records(pages: DataFrame, heads: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One column `record`: a WARC record as text without its end mark, for each row of pages. heads: see classify."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_replace(url_col, r"[\r\n]", ""), F.lit("")).alias("uri"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).join(heads, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    rows = rows.select("id", "uri", "digest", "first_id", revisit.alias("revisit"), block.alias("block"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("uri")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", name(F.col("first_id"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, "block").alias("record"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, records_per_file: int = 4000, file_bytes: int = FILE_BYTES, **options: str) -> None:
    """Write a record for every row of pages to archives in the folder `path`.

    An archive has at most records_per_file records and so few that the largest page as often would
    stay within file_bytes, so a reader's task can hold it. Null payloads are empty and null urls are
    empty; a null id is written as `null` and is never a response that others refer to; repeated
    rows get a record each; other columns are not read; an empty table gives no record.
    """
    heads, most = classify(pages, id_col, payload_col, url_col, least_bytes)
    out = records(pages, heads, id_col, url_col, payload_col)
    out.write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, min(records_per_file, file_bytes // (most + 1000)))).options(**options).text(path)
    discard(heads)


# ---- reading


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Short(ValueError):
    """The bytes end before the record does."""


def header_lines(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for raw in data.split(b"\r\n"):
        key, colon, value = raw.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        out.setdefault(key.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


def parse_record(data: bytes, at: int, with_payload: bool) -> tuple[dict, int]:
    """The record that begins at `at` and where it ends; ValueError names the first check it fails."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise (Short if len(data) - at < len(VERSION) + 2 else ValueError)("no version line")
    split = data.find(END, line.end())
    if split < 0:
        raise Short("headers do not end")
    head = header_lines(data[line.end() : split])
    if not all(k in head for k in ("warc-type", "warc-record-id", "content-length")) or not head["content-length"].isdigit():
        raise ValueError("a required header is missing or malformed")
    start = split + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != END:
        raise (Short if len(data) < stop + 4 else ValueError)("the block does not end where its length says")
    block = data[start:stop]
    said = head.get("warc-block-digest", "").partition(":")
    if said[0].lower() == "sha1" and said[2] != sha1_32(block):
        raise ValueError("block digest differs")
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        size = len(payload)
    said = head.get("warc-payload-digest", "").partition(":")
    if head["warc-type"] == "revisit":
        digest, payload = said[2] or None, None
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http) if head.get("content-type", "").startswith("application/http") else None
        size = int(found[1]) if found else None
    else:
        digest = sha1_32(payload)
        if said[0].lower() == "sha1" and said[2] != digest:
            raise ValueError("payload digest differs")
    row = {"kind": "record", "record_type": head["warc-type"], "record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size}
    return row | ({"payload": payload} if with_payload else {}), stop + 4


def salvage_stream(chunks: Iterator[bytes], with_payload: bool) -> Iterator[dict]:
    """Records and gaps (without offsets) of bytes that come in chunks; holds one record and one chunk of them.

    After a failed check the search goes on at the next version line. A record whose length is said to go beyond
    what has come waits for more, up to RECORD_BYTES.
    """
    held, ended, reason = b"", False, ""
    while held or not ended:
        try:
            row, stop = parse_record(held, 0, with_payload)
        except ValueError as failed:
            if isinstance(failed, Short) and not ended and len(held) < RECORD_BYTES and (not held or held[:1] == VERSION[:1]):
                parts, more = [held], 0
                while more <= len(held):
                    part = next(chunks, None)
                    if part is None:
                        ended = True
                        break
                    parts.append(part)
                    more += len(part)
                held = b"".join(parts)
                continue
            if not held:
                break
            reason = reason or str(failed)
            found = VERSION_LINE.search(held, 1)
            # Without a mark, only a beginning of one may be left at the end.
            held = held[found.start() :] if found else b"" if ended else held[max(1, len(held) - len(VERSION) - 1) :]
            if not found and not ended:
                part = next(chunks, None)
                ended = part is None
                held += part or b""
            continue
        if reason:
            yield {"kind": "gap", "reason": reason}
            reason = ""
        yield row
        held = held[stop:]
    if reason:
        yield {"kind": "gap", "reason": reason}


def inflate(data: bytes, at: int, step: int = 1 << 16) -> Iterator[bytes]:
    """Decompressed bytes of the gzip member at `at`, at most 16 steps at once; what came before any damage."""
    engine, pos, left = zlib.decompressobj(31), at, b""
    try:
        while not engine.eof and (left or pos < len(data)):
            out = engine.decompress(left or data[pos : pos + step], 16 * step)
            pos, left = pos if left else pos + step, engine.unconsumed_tail
            if out:
                yield out
    except zlib.error:
        return


def extent(data: bytes, at: int, step: int = 1 << 16) -> tuple[int, str]:
    """Where the gzip member at `at` ends and what is wrong (empty: nothing); holds a step of its output."""
    engine, pos, left = zlib.decompressobj(31), at, b""
    try:
        while not engine.eof and (left or pos < len(data)):
            engine.decompress(left or data[pos : pos + step], 16 * step)
            pos, left = pos if left else pos + step, engine.unconsumed_tail
    except zlib.error as failed:
        return -1, f"gzip: {failed}"
    if not engine.eof:
        return -1, "gzip: the member is cut off"
    return min(pos, len(data)) - len(engine.unused_data), ""


def resume(data: bytes, at: int) -> int:
    """The next gzip member or version line after `at` from which a record passes, or the end."""
    for mark in MARK.finditer(data, at + 1):
        nxt = mark.start()
        if data.startswith(MEMBER, nxt):
            if any(row["kind"] == "record" for row in salvage_stream(inflate(data, nxt), False)):
                return nxt
            continue
        try:
            parse_record(data, nxt, False)
        except ValueError:
            continue
        return nxt
    return len(data)


def salvage(data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive, plain, of gzip members or mixed.

    Offsets are of the file as stored; for a record in a gzip member, of its member.
    """
    at = 0
    while at < len(data):
        if data.startswith(MEMBER, at):
            stop, wrong = extent(data, at)
            for row in salvage_stream(inflate(data, at), with_payload):
                # What a damaged member gave before the damage still counts where it passes all checks.
                if stop >= 0 or row["kind"] == "record":
                    yield row | {"start": at, "stop": max(at, stop)}
            if stop >= 0:
                at = stop
                continue
        else:
            try:
                row, stop = parse_record(data, at, with_payload)
            except ValueError as failed:
                wrong = str(failed)
            else:
                yield row | {"start": at, "stop": stop}
                at = stop
                continue
        nxt = resume(data, at)
        yield {"kind": "gap", "reason": wrong, "start": at, "stop": nxt}
        at = nxt


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind `record` and `gap` of every archive below path; see ROW for the columns.

    A file is read whole by one task: keep archives well below the memory of a task (1 GB is
    customary). A gzip member is decompressed in steps, of which one record is held. Files without any record give one gap that covers them; empty files give no row.
    A damaged record that holds a whole valid record in its payload yields the inner one.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for row in salvage(content.as_py(), with_payload):
                    held.append(row | {"path": name.as_py()})
                    size += 200 + len(row.get("payload") or b"")
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, SCHEMA)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ROW)


def page_id(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Write pages to archives in the shared folder and read them back: (records, quarantined gaps).

    Nulls, empty and long payloads, ties, repeated rows, empty tables and other columns: as write_warc says.
    The archives stay in the shared folder, since both results are read from them.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, **how)
    rows = read_warc(spark, path, with_payload=False)
    return rows.where("kind = 'record'"), rows.where("kind = 'gap'")
