"""WARC archives: one gzip member a record, written by tasks and read back sequentially.

Writing: the rows of a task go, record by record, into archives of about ``ARCHIVE_MB`` in a shared folder.  An attempt
writes under names of its own and only then gives rows of a manifest, which Spark commits; archives of lost attempts
are in no manifest and so are never read.  Reading: a task takes one archive at a time from front to back.  Compressed
bytes are inflated piece by piece (``CHUNK`` bytes at most go in or come out at once), a header says by Content-Length
how long its block is, and the block's and the payload's digests are worked out anew and compared.  A task holds one
record and one batch of rows at a time.

Copies: of records with equal payloads (by SHA-256) of ``LEAST_BYTES`` at least, the one with the smallest id is a
response, the others revisit it and carry no payload.  Only ids, addresses and digests are grouped, summed before they
are dealt; payloads move at most once, to meet their group's head, and not at all where Spark finds the heads small
enough to broadcast.

Rules: a null payload is empty; an empty payload makes a record of its own; a payload of any length is one record; a
null id comes after all others, and is null when read back; of rows with one id and payload the one with the smallest
address (null last) is the response, of wholly equal rows any one; an empty table makes no archive and no rows; further
columns are ignored, whatever their names.  When reading, a digest that differs is named in ``error`` and reading goes
on behind that record; a header, a length or a member that can't be read makes one row with an error and ends that
archive; ``strict`` makes either an exception.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm._spark import cut, shared_dir, small_batches, table

ARCHIVE_MB = 64
CHUNK = 1 << 18
LEAST_BYTES = 100
BATCH_MB = 16
HEADER_BYTES = 1 << 20
COPIES = 1_000_000
#: Named in the WARC 1.1 standard.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, n_records long, n_bytes long"
READ = "archive string, offset long, record_type string, record_id string, record_key string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


class BadArchive(ValueError):
    pass


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if re.match("file:/", path):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


# ---- writing


def _line(text: str) -> str:
    """A header value: what could end it is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n"])
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packed.compress(head.encode()), packed.compress(block), packed.compress(b"\r\n\r\n"), packed.flush()])


def _digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def _record(row: dict, record_id: str, date: str) -> bytes:
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type']}\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + payload if row["record_type"] == "response" else http
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _line(row["target_uri"] or record_id))]
    if row["record_key"] is not None:
        headers.append(("X-Record-Key", _line(row["record_key"])))
    if row["record_type"] == "revisit":
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    headers += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, block)


def _writer(folder: str, date: str, archive_bytes: int):
    def run(batches):
        fs, root = _opened(folder)
        out, name, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        try:
            for batch in batches:
                columns = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    row = {c: x[i].as_py() for c, x in columns.items()}
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        block = b"software: barspark\r\nformat: WARC File Format 1.1\r\n"
                        size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/warc-fields")], block))
                    size += out.write(_record(row, row["record_id"] or uuid.uuid4().urn, date))
                    n += 1
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        done.append((f"{folder}/{name}", n, size))
            if out is not None:
                out.close()
                out = None
                done.append((f"{folder}/{name}", n, size))
        finally:
            if out is not None:
                out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], names=["archive", "n_records", "n_bytes"])

    return run


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The records that archives of pages hold: key, address, payload (of responses only), its digest and length, type, record id and the id it refers to."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = F.struct(F.isnull("k").alias("a"), F.col("k").alias("k"), F.isnull("u").alias("b"), F.col("u").alias("u"), F.col("c").alias("c"))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes", "k", "u").agg(F.count("*").alias("c"))
    heads = groups.groupBy("payload_digest", "payload_bytes").agg(F.sum("c").alias("n"), F.min(first).alias("h")).filter("n > 1")
    heads = cut(heads.select("payload_digest", "payload_bytes", F.col("h.k").alias("hk"), F.col("h.u").alias("hu"), F.col("h.c").alias("copies")))
    both = rows.join(heads.drop("payload_bytes"), "payload_digest", "left")
    alone, head = F.isnull("copies"), F.col("k").eqNullSafe(F.col("hk")) & F.col("u").eqNullSafe(F.col("hu"))
    shared_id = F.concat(F.lit("urn:sha256:"), F.col("payload_digest"))

    def records(found: DataFrame, response) -> DataFrame:
        named = found.select(
            F.col("k").cast("string").alias("record_key"), F.col("u").cast("string").alias("target_uri"), F.when(response, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
            F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(response & ~alone, shared_id).alias("record_id"), F.when(~response, shared_id).alias("refers_to"),
        )
        return named

    if heads.filter("copies > 1").isEmpty():
        return records(both, alone | head)
    # wholly equal heads: one row is the response, the others are written from their number
    repeated = ~alone & head & (F.col("copies") > 1)
    one = both.filter(repeated).dropDuplicates(["payload_digest"])
    again = heads.filter("copies > 1").withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 2, F.lit(COPIES).cast("long"))))
    again = again.withColumn("nth", F.explode(F.sequence(F.col("left"), F.least(F.col("left") + COPIES - 1, F.col("copies") - 2))))
    again = again.select(F.col("hk").alias("k"), F.col("hu").alias("u"), F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_digest", "copies")
    return records(both.filter(~repeated), alone | head).unionByName(records(one, F.lit(True))).unionByName(records(again, F.lit(False)))


def write_warc(records: DataFrame, folder: str, archive_mb: float = ARCHIVE_MB, content_type: str = "text/html; charset=utf-8", date: str | None = None) -> DataFrame:
    """Write records (as ``with_revisits`` gives them) into archives in a folder that all executors share; the manifest of these archives."""
    small_batches(records.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return cut(records.withColumn("content_type", F.lit(content_type)).mapInArrow(_writer(folder.rstrip("/"), date, int(archive_mb * 1e6)), MANIFEST))


# ---- reading


class Inflated:
    """The inflated bytes of an archive of gzip members (or of plain records), a bounded piece at a time."""

    def __init__(self, raw, chunk: int = CHUNK):
        self.raw, self.chunk = raw, chunk
        self.pending, self.at, self.member, self.plain = b"", 0, 0, None
        self.out, self.inflate = bytearray(), None

    def more(self) -> bool:
        """Add the next piece to ``out``; false at the end of the archive."""
        if not self.pending:
            self.pending = self.raw.read(self.chunk)
        if self.plain is None and self.pending:
            while len(self.pending) < 2 and (next_byte := self.raw.read(1)):
                self.pending += next_byte
            self.plain = not self.pending.startswith(b"\x1f\x8b")
        if self.plain:
            self.out += self.pending
            more, self.at, self.pending = bool(self.pending), self.at + len(self.pending), b""
            return more
        if self.inflate is None:
            if not self.pending:
                return False
            self.member, self.inflate = self.at, zlib.decompressobj(31)
        try:
            piece = self.inflate.decompress(self.pending, self.chunk)
        except zlib.error as error:
            raise BadArchive(f"a member can't be inflated: {error}") from error
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        if not self.pending and not piece and not self.inflate.eof:
            raise BadArchive("the last member is cut short")
        self.at, self.pending = self.at + len(self.pending) - len(rest), rest
        if self.inflate.eof:
            self.inflate = None
        self.out += piece
        return True

    def ended(self) -> None:
        """Take in the end of a member whose data is used up, so that the next record begins where its member does."""
        while not self.out and self.inflate is not None:
            self.more()

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to and with a mark; None where the archive ends at once."""
        seen = 0
        while (found := self.out.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.out)
            if seen > most:
                raise BadArchive("a header doesn't end")
            if not self.more():
                if self.out:
                    raise BadArchive("a header is cut short")
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise BadArchive("a block is cut short")
        taken = bytes(memoryview(self.out)[:n])
        del self.out[:n]
        return taken


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise BadArchive("no record stands where one should")
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t"):
            fields[name] = f"{fields.get(name, '')} {line.strip()}"
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _verified(stated: str | None, data: bytes) -> bool:
    """Whether data has the stated digest (hexadecimal or base 32); an unstated one, or one of an unknown kind, can't fail."""
    kind, _, value = (stated or "").partition(":")
    kind = kind.lower().replace("-", "")
    if not value or kind not in hashlib.algorithms_guaranteed or kind.startswith("shake"):
        return True
    made = hashlib.new(kind, data)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def read_records(raw, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of one archive in order, from an object with read(n)."""
    source = Inflated(raw, chunk)
    while True:
        offset = source.at
        try:
            source.ended()
            offset = source.member if source.out else source.at
            head = source.until(b"\r\n\r\n", HEADER_BYTES)
            if head is None:
                return
            fields = _fields(head)
            if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
                raise BadArchive("a record has no length")
            block = source.take(int(fields["content-length"]))
            if source.take(4) != b"\r\n\r\n":
                raise BadArchive("a record doesn't end where its length says")
        except BadArchive as error:
            yield {"offset": offset, "error": str(error)}
            return
        kind, wrong = fields.get("warc-type", ""), []
        http = fields.get("content-type", "").lower().startswith("application/http")
        top, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        payload = None if kind == "revisit" else body
        if not _verified(fields.get("warc-block-digest"), block):
            wrong.append("the block has another digest")
        if payload is not None and not _verified(fields.get("warc-payload-digest"), payload):
            wrong.append("the payload has another digest")
        stated = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", top)
        strip = lambda x: x[1:-1] if x and x[:1] == "<" and x[-1:] == ">" else x
        yield {
            "offset": offset, "record_type": kind, "record_id": strip(fields.get("warc-record-id")), "record_key": fields.get("x-record-key"), "target_uri": strip(fields.get("warc-target-uri")), "date": fields.get("warc-date"),
            "refers_to": strip(fields.get("warc-refers-to")), "payload": payload, "payload_bytes": len(payload) if payload is not None else int(stated[1]) if stated else None,
            "payload_digest": hashlib.sha256(payload).hexdigest() if payload is not None else fields.get("warc-payload-digest", "").partition(":")[2].lower() or None, "error": "; ".join(wrong) or None,
        }


def _reader(strict: bool, payloads: bool, out: pa.Schema):
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=out)

    def run(batches):
        rows, held = [], 0
        for given in batches:
            for archive in given.column("archive").to_pylist():
                fs, path = _opened(archive)
                with fs.open_input_stream(path, compression=None) as raw:
                    for record in read_records(raw):
                        if strict and record["error"]:
                            raise BadArchive(f"{archive} at {record['offset']}: {record['error']}")
                        payload = record.get("payload")
                        held += len(payload or b"") if payloads else 0
                        rows.append(record | {"archive": archive, "payload": payload if payloads else None})
                        if len(rows) >= 1000 or held >= BATCH_MB << 20:
                            yield batch(rows)
                            rows, held = [], 0
        yield batch(rows)

    return run


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """Archives that a path or pattern names; Spark lists them and reads none."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))


def read_warc(archives: DataFrame, strict: bool = False, payloads: bool = True) -> DataFrame:
    """The records of all archives that a table names in its column ``archive`` (a manifest, or ``archives_in``), verified; without ``payloads`` their lengths and digests alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = archives.sparkSession
    out = to_arrow_schema(spark.createDataFrame([], READ).schema)
    names = archives.select("archive")
    # an archive is the unit of a sequential reader; each gets a task while there are not too many
    return names.repartition(max(1, min(names.count(), 10_000))).mapInArrow(_reader(strict, payloads, out), READ)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the length, digest and key of the response that each revisit refers to; a digest that isn't the response's, and a revisit of nothing, is an error."""
    original = records.filter("record_type = 'response'").select(F.col("record_id").alias("o_id"), F.col("record_key").alias("o_key"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest"))
    own = records.filter("record_type <> 'revisit' or record_type is null").withColumn("refers_to_key", F.lit(None).cast("string"))
    again = records.filter("record_type = 'revisit'").join(original, F.col("refers_to") == F.col("o_id"), "left")
    wrong = F.when(F.isnull("o_id"), "it revisits no record here").when(F.col("payload_digest") != F.col("o_digest"), "it revisits another payload")
    again = again.withColumn("error", F.concat_ws("; ", "error", wrong)).withColumn("error", F.when(F.col("error") != "", F.col("error")))
    again = again.withColumn("payload_bytes", F.col("o_bytes")).withColumn("payload_digest", F.col("o_digest")).withColumn("refers_to_key", F.col("o_key"))
    return own.unionByName(again.select(own.columns))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    manifest = write_warc(with_revisits(table(spark, sf_dir, "pages")), folder)
    back = resolved(cut(read_warc(manifest, strict=True, payloads=False).filter("record_type <> 'warcinfo'").drop("payload")))
    ok = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_type"))
    return back.select(F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", ok.alias("record_type"), F.col("refers_to_key").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head,
             row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN head END AS refers_to
FROM h
"""
