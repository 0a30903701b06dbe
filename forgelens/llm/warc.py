"""WARC archives: writing pages with segments and revisits, reading and reassembling."""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import save, shuffle_partitions

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_chunked(data: bytes, size: int) -> bytes:
    """The data in chunked transfer framing."""
    out = []
    for at in range(0, len(data), size):
        chunk = data[at : at + size]
        out += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    """The data of a body in chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(text) -> str | None:
    return None if text is None else re.sub(r"[\s\x00-\x1f<>]", lambda m: f"%{ord(m[0]):02X}", text)


def page_records(page_id, url, payload: bytes, refers_to, row: str, segment: int, chunk: int):
    """The records of one page: a revisit, or a response and its continuations."""
    digest = payload_digest(payload)
    name = f"<urn:x-page:{page_id}:{digest}#{row}"
    common = [("WARC-Target-URI", _uri(url)), ("WARC-Date", DATE)]
    about = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", name + ">"), *common, *about,
             ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{digest}>"), ("WARC-Profile", profile)],
            block,
        )
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n"
    block += encode_chunked(payload, chunk)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name + ">"), *common, *about]
    if len(block) <= segment:
        yield _record(first, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name}.{number}>"), *common,
             ("WARC-Segment-Origin-ID", name + ">"), ("WARC-Segment-Number", number),
             ("WARC-Segment-Total-Length", total)],
            part,
        )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 0,
    segment: int = 1 << 16,
    chunk: int = 1 << 14,
    compression: str = "gzip",
) -> None:
    """Writes every page as WARC 1.1 records below ``path``.

    Of equal payloads of at least ``revisit_bytes`` bytes, the page with the smallest
    id is a response (all of them, if rows repeat that id) and the others revisit it;
    a null id comes after all others.  Null payloads count as empty, null urls are
    left out.  Blocks above ``segment`` bytes are written as continuation records.
    Files are gzip streams by default.  An empty table writes no records.

    Digests are grouped as narrow rows, and the groups written, so that the copies of one
    payload can be split among the tasks of a join; page contents move once, to meet
    their roles.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")
    )
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    long_enough = F.octet_length("_payload") >= revisit_bytes
    narrow = rows.where(long_enough).select("_id", "_sha")
    groups = narrow.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    groups = save(groups.where("_n > 1").drop("_n"), "payload-groups")
    revisits = (
        narrow.join(groups, "_sha")
        .where(~F.col("_id").eqNullSafe(F.col("_first")))
        .select(F.col("_id").alias("_rid"), F.col("_sha").alias("_rsha"), "_first")
        .distinct()
    )
    roles = rows.join(
        revisits, rows["_id"].eqNullSafe(revisits["_rid"]) & (rows["_sha"] == revisits["_rsha"]), "left"
    ).select("_id", "_url", "_payload", "_first")

    def records(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page_id, url, data, first in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                for record in page_records(page_id, url, data, first, f"{part}.{n}", segment, chunk):
                    out.append(record)
                    size += len(record)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # a record ends with two line ends, which the text writer puts after each row
    made = roles.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "origin_id": "WARC-Segment-Origin-ID",
    "segment": "WARC-Segment-Number",
    "total_length": "WARC-Segment-Total-Length",
}
_NUMBERS = {"segment", "total_length"}
_RECORD = T.StructType(
    [T.StructField(n, T.LongType() if n in _NUMBERS else T.StringType()) for n in _FIELDS]
    + [T.StructField("block", T.BinaryType()), T.StructField("error", T.StringType())]
)


_START = b"WARC/1."
_HEADER_END = re.compile(rb"\r?\n\r?\n")
_BREAKS = re.compile(rb"[\r\n]*")
LONGEST_HEADER = 1 << 20


def header_fields(head: bytes) -> dict:
    """Header fields by lower-case name; a line that begins with a space goes on with the last one."""
    fields: dict[str, str] = {}
    last = None
    for line in head.split(b"\n")[1:]:
        if line[:1] in (b" ", b"\t") and last is not None:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower().decode("utf-8", "replace")
        fields[last] = value.strip().decode("utf-8", "replace")
    return fields


class RecordReader:
    """Cuts the bytes of one archive, fed piece by piece, into records by their Content-Length.

    A record is (fields, block, error).  What stands in a block is never looked at.  Where
    a record has no usable length or ends early, or bytes stand where a record should
    begin, a record with an error is given and reading goes on at the next line that
    begins one.  No more than one record and one piece is held.
    """

    def __init__(self):
        self.pieces: list[bytes] = []
        self.size = 0
        self.wanted = 0  # bytes without which nothing more can be cut
        self.lost = 0  # bytes skipped since the last record
        self.skipping = False

    def feed(self, data: bytes, last: bool = False):
        self.pieces.append(data)
        self.size += len(data)
        if self.size < self.wanted and not last:
            return
        buffer = b"".join(self.pieces)
        at = 0
        while True:
            found = self._cut(buffer, at, last)
            if found is None:
                break
            at, record = found
            if record is not None:
                yield record
        rest = buffer[at:]
        self.pieces, self.size = [rest], len(rest)
        if last and self.lost:
            yield {}, None, f"{self.lost} bytes that belong to no record"

    def _cut(self, buffer: bytes, at: int, last: bool):
        """(place after it, record or None) of what begins at a place; None to wait for more."""
        self.wanted = 0
        if self.skipping:
            found = buffer.find(b"\n" + _START, at)
            if found < 0:
                end = len(buffer) if last else max(at, len(buffer) - len(_START))
                self.lost += len(buffer[at:end].strip(b"\r\n"))
                return (end, None) if end > at else None
            lost = self.lost + len(buffer[at:found].strip(b"\r\n"))
            self.lost, self.skipping = 0, False
            return found + 1, ({}, None, f"{lost} bytes that belong to no record") if lost else None
        begin = _BREAKS.match(buffer, at).end()
        if begin == len(buffer) or not last and _START.startswith(buffer[begin : begin + len(_START)]) and (
            len(buffer) - begin < len(_START)
        ):
            return (begin, None) if begin > at else None
        if not buffer.startswith(_START, begin):
            self.skipping = True
            return begin, None
        end = _HEADER_END.search(buffer, begin)
        if end is None and not last and len(buffer) - begin <= LONGEST_HEADER:
            self.wanted = len(buffer) - at + 1
            return None
        if end is None or end.start() - begin > LONGEST_HEADER:
            self.skipping = True
            return begin + len(_START), ({}, None, "a header that does not end")
        fields = header_fields(buffer[begin : end.start()])
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            self.skipping = True
            return end.end() - 1, (fields, None, f"no usable Content-Length: {length[:80]!r}")
        stop = end.end() + int(length)
        if stop <= len(buffer):
            return stop, (fields, buffer[end.end() : stop], None)
        if last:
            return len(buffer), (fields, buffer[end.end() :], "cut short")
        self.wanted = stop - at
        return None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of all archives below ``path``, the lines of a file in their order in one partition.

    Compressed files are not split by Spark; the lines of others are brought together
    again by file.
    """
    read = lambda glob: spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    name = F.xxhash64("_metadata.file_path")
    line = F.col("value").cast("binary").alias("line")
    whole = read("*.gz").select(name.alias("file"), line)
    split = read("{*[!z],*[!g]z,*[!.]gz,z,gz}").select(
        name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), line
    )
    together = split.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "block", "nth")
    return whole.unionByName(together.select("file", "line"))


def read_warc(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """The records below ``path``, as they stand; ``segmented`` selects by segment number.

    Archives of any WARC 1.x version, records cut by their Content-Length, whatever their
    blocks hold; files ending in .gz are gzip streams, of one or many members.  ``error``
    says what is wrong with a record that cannot be read (no usable length or segment
    number, cut short, bytes between records); its block is what there is of it, or null.
    Such rows come with ``segmented`` unset or false.
    """

    def parse(batches):
        reader, current = RecordReader(), None
        rows: list[dict] = []
        size = 0

        def kept(records):
            nonlocal size
            for fields, block, error in records:
                row = {n: fields.get(name.lower()) for n, name in _FIELDS.items()}
                for n in _NUMBERS:
                    value = row[n]
                    if value is not None:
                        good = value.isascii() and value.isdigit() and len(value) < 19
                        row[n] = int(value) if good else None
                        error = error if good else f"no usable {_FIELDS[n]}: {value[:80]!r}"
                apart = row["segment"] is not None and error is None
                if segmented is None or segmented == apart:
                    rows.append(row | {"block": block, "error": error})
                    size += len(block or b"")

        for batch in batches:
            files, values = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)] if len(files) else []
            for a, b in zip(edges, edges[1:]):
                data = b"\n".join(values[a:b])
                if current == files[a]:
                    kept(reader.feed(b"\n" + data))
                else:
                    kept(reader.feed(b"", last=True))
                    reader, current = RecordReader(), files[a]
                    kept(reader.feed(data))
            if size > 1 << 23:
                yield made(rows)
                rows, size = [], 0
        kept(reader.feed(b"", last=True))
        yield made(rows)

    def made(rows):
        kind = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
        columns = [pa.array([r[f.name] for r in rows], kind[f.dataType]) for f in _RECORD]
        return pa.RecordBatch.from_arrays(columns, _RECORD.names)

    return _lines(spark, path).mapInArrow(parse, _RECORD)


def reassembled(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record below ``path``, its HTTP payload decoded.

    Continuations are grouped by the record they continue, ordered by segment number
    and their total length verified; only segmented records are shuffled.  Columns:
    record_id, record_type, target_uri, refers_to, n_segments, complete, payload,
    payload_bytes, payload_digest (bare, upper case), error.  A record that could not be
    read, with a missing or repeated segment, of another length than stated, or with
    chunks that do not fit, is not complete and its payload columns are null; ``error``
    says why.  A revisit has no payload of its own: its length and digest are those it
    states.
    """
    keys = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest"]
    whole = read_warc(spark, path, segmented=False).select(
        *keys, F.array("block").alias("blocks"), F.col("error").isNull().alias("complete"), "error"
    )
    origin = F.coalesce("origin_id", "record_id")
    head = F.col("segment") == 1
    grouped = (
        read_warc(spark, path, segmented=True)
        .groupBy(origin.alias("origin"))
        .agg(
            *[F.max(F.when(head, F.col(k))).alias(k) for k in keys],
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
            F.max("total_length").alias("total"),
        )
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate(
        "parts", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["block"])
    )
    complete = (
        F.transform(numbers, lambda n, i: n == i + 1) == F.array_repeat(F.lit(True), F.size("parts"))
    ) & (length == F.col("total"))
    pieced = grouped.select(
        F.coalesce("record_id", "origin").alias("record_id"),
        *keys[1:],
        F.transform("parts", lambda p: p["block"]).alias("blocks"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
        F.when(~F.coalesce(complete, F.lit(False)), "segments that do not make a whole").alias("error"),
    )
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in keys[:-1]]
        + [
            T.StructField("n_segments", T.LongType()),
            T.StructField("complete", T.BooleanType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def decode(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            payloads, sizes, digests = [], [], []
            blocks, stated = columns["blocks"].to_pylist(), columns["payload_digest"].to_pylist()
            kinds, fine = columns["record_type"].to_pylist(), columns["complete"].to_pylist()
            errors = columns["error"].to_pylist()
            for i, (parts, digest, kind) in enumerate(zip(blocks, stated, kinds)):
                payload = n = own = None
                if fine[i]:
                    try:
                        payload, n = http_payload(b"".join(parts), kind == "revisit")
                        own = (digest or "").removeprefix("sha1:") if payload is None else payload_digest(payload)
                    except ValueError as problem:
                        fine[i], errors[i] = False, f"chunked framing: {problem}"
                payloads.append(payload)
                sizes.append(n)
                digests.append(own)
            yield pa.RecordBatch.from_arrays(
                [columns[k] for k in keys[:-1]]
                + [pa.array(map(len, blocks), pa.int64()), pa.array(fine, pa.bool_()),
                   pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                   pa.array(errors, pa.string())],
                schema.names,
            )

    return whole.unionByName(pieced).mapInArrow(decode, schema)


def http_payload(block: bytes, revisit: bool) -> tuple[bytes | None, int | None]:
    """(payload, its length) of an HTTP response block; a revisit's states the length only."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))}
    if revisit:
        return None, int(fields[b"content-length"]) if b"content-length" in fields else None
    if b"chunked" in fields.get(b"transfer-encoding", b"").lower():
        body = decode_chunked(body)
    return body, len(body)
