"""WARC archives written and read back as Spark jobs.

Writing: records are strings of header, HTTP header and payload; Spark's text writer puts
``CR LF CR LF`` behind each, which makes each part file a WARC archive, in any store and
with Spark's commit of tasks.  Of records with equal payloads one is a response, the others
revisit it.

Reading: the magic ``WARC/1.0`` is the line separator of Spark's text reader, so each row
begins at a candidate record.  An archive is read by one task from its start, in one linear pass with a
bounded state (the reader gets a session of its own whose scans are not split; gzip can't be split anyway, and
the writer's files are bounded by Spark's partitions).  The task adds up offsets and emits for every candidate,
from its header alone, the offset where its successor must begin.  Headers that go on over the
magics that follow are parsed once, from their common end backwards.  Pointer jumping over the
table of (file, offset, successor) marks what can be reached from the start of the file; in
each round the marked records mark their targets and every pointer doubles its reach.
Candidates that are not reached stood inside payloads and are left out.

Digests need a payload's bytes in order, so they are formed in the same pass, of one candidate at a time: one
whose magic stands inside the block of another such candidate has none.  Every reached record has one,
as the first is at the start of the file and the block of each ends before its successor begins.

Nulls: a null html is an empty payload, a null url an empty URI.  A null page_id is written
as `null` and comes back as null; it is the response only if all equal payloads have null
ids.  Rows that repeat the page_id and payload of a response are responses too.
No pages give no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import dropped, fresh_path, staged

LEAST_BYTES = 0
BROADCAST_ROWS = 100_000
MAGIC = "WARC/1.0\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four characters."""
    parts = []
    for g in range(8):
        v = F.conv(F.substring(F.sha1(payload), g * 5 + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(BASE32), F.shiftright(v, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The text of one record per row of pages (page_id, url, html), without its closing line ends."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    equal = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("first"), F.lit(True).alias("shared"))
    equal = staged(equal.where("c > 1").drop("c"), "equal")
    # a small table goes to all tasks; a larger one meets the pages in a shuffle, whose skewed partitions Spark splits
    few = F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    both = rows.join(few, "digest", "left").withColumn("revisit", F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return both.select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", named(F.col("page_id"))),
            line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", named(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, per_file: int = 0) -> None:
    """Writes the pages as WARC files (gzip), one for each of Spark's partitions, whose bytes its settings bound; per_file: of at most so many records, if not 0."""
    records(pages, least).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


HEADER_BYTES = 1 << 16  # a longer header makes no record
END = b"\r\n\r\n"
#: The named fields of a record that are read.
FIELDS = (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest", b"content-length")

CANDIDATES = (
    "file string, offset long, next long, record_type string, page_id long, refers_to long, uri string, payload_bytes long, payload_digest string"
)
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def fields_of(head: bytes) -> dict[bytes, bytes]:
    """The FIELDS among the lines of a header; of repeated ones the last."""
    pairs = (x.partition(b":") for x in head.split(b"\r\n"))
    return {k: v.strip() for name, _, v in pairs if (k := name.strip().lower()) in FIELDS}


def _number(value: bytes) -> int | None:
    value = value.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(value) if value.removeprefix(b"-").isdigit() else None


class _Block:
    """The block of a candidate as it passes: size and digest of what follows its HTTP header."""

    def __init__(self, row: list, need: int):
        self.row, self.need, self.http, self.held, self.size, self.sha = row, need, None, bytearray(), 0, hashlib.sha1()

    def add(self, part: bytes) -> None:
        part = part[: self.need]
        self.need -= len(part)
        if self.http is None:
            seen = max(len(self.held) - len(END) + 1, 0)
            self.held += part
            at = self.held.find(END, seen)
            if at < 0 and self.need and len(self.held) <= HEADER_BYTES:
                return
            # a block without an HTTP header is all payload
            self.http, part = (bytes(self.held[:at]), bytes(self.held[at + len(END) :])) if at >= 0 else (b"", bytes(self.held))
        self.size += len(part)
        self.sha.update(part)

    def done(self, digest: bytes) -> list:
        """The candidate's row; the payload of a revisit is that of the record it refers to."""
        size, own = self.size, base64.b32encode(self.sha.digest()).decode()
        if self.row[3] == "revisit":
            stated = [x.split(b":")[1].strip() for x in (self.http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(stated[0]) if stated and stated[0].isdigit() else 0
            own = digest.decode("utf-8", "replace").removeprefix("sha1:")
        return [*self.row, size, own]


class Archive:
    """One pass over an archive, given as what stands before the first magic and behind each."""

    def __init__(self, file: str, place: int):
        self.file, self.place = file, place
        self.held, self.start, self.heads = bytearray(), 0, deque()  # bytes from the first open header on, their offset, and the offsets of open candidates
        self.seen = 0  # bytes of held in which no header ends
        self.block, self.digest, self.free = None, b"", 0  # free: where the last such block ends

    def add(self, seg: bytes) -> Iterator[list]:
        """Rows of the candidates whose headers or blocks end in a segment, which a magic stands before."""
        if self.block is not None:
            yield from self._passed(MAGIC.encode() + seg)
        if self.heads:
            self.held += MAGIC.encode()
        else:
            self.held, self.start, self.seen = bytearray(), self.place + len(MAGIC), 0
        self.heads.append(self.place)
        self.held += seg
        self.place += len(MAGIC) + len(seg)
        while self.heads:
            first = self.heads[0] + len(MAGIC) - self.start
            at = self.held.find(END, max(first, self.seen - len(END) + 1))
            ends = at if at >= 0 else len(self.held)
            while self.heads and ends - (self.heads[0] + len(MAGIC) - self.start) > HEADER_BYTES:
                self.heads.popleft()  # too long
            if at < 0:
                self.seen = len(self.held)
                break
            yield from self._headed(at)
        if not self.heads:
            self.held, self.seen = bytearray(), 0
        elif (gone := self.heads[0] + len(MAGIC) - self.start) > HEADER_BYTES:
            del self.held[:gone]
            self.start, self.seen = self.start + gone, max(self.seen - gone, 0)

    def _headed(self, at: int) -> Iterator[list]:
        """Candidates whose header ends at that place of `held`: of lines that several share, each looks at them once."""
        own = []
        while self.heads and self.heads[0] + len(MAGIC) - self.start <= at:
            own.append(self.heads.popleft())
        fields, to, rows = {}, at, []
        for offset in reversed(own):
            lo = offset + len(MAGIC) - self.start
            fields = fields_of(bytes(self.held[lo:to])) | fields
            to = lo
            length = fields.get(b"content-length", b"")
            if length.isdigit() and len(length) <= 18:
                rows.append((offset, int(length), fields))
        block_at = self.start + at + len(END)
        for offset, length, fields in reversed(rows):
            text = lambda c: fields.get(c, b"").decode("utf-8", "replace")  # noqa: E731, B023
            row = [self.file, offset, block_at + length + len(END), text(b"warc-type"), _number(fields.get(b"warc-record-id", b"")), _number(fields.get(b"warc-refers-to", b"")), text(b"warc-target-uri") if b"warc-target-uri" in fields else None]
            if offset >= self.free:
                self.free = block_at + length
                self.block, self.digest = _Block(row, length), fields.get(b"warc-payload-digest", b"")
                yield from self._passed(bytes(self.held[at + len(END) :]))
            else:
                yield [*row, None, None]

    def _passed(self, part: bytes) -> Iterator[list]:
        self.block.add(part)
        if not self.block.need:
            yield self.block.done(self.digest)
            self.block = None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    archive = None
    for b in batches:
        done, values = [], b.column("value")
        if (b.column("start").to_numpy() > 0).any():
            raise ValueError("an archive was split; offsets count from its start")
        for k, name in enumerate(b.column("file").to_pylist()):
            seg = values[k].as_py()
            if archive is None or name != archive.file:  # what stands before the first magic
                archive = Archive(name, len(seg))
            else:
                done += archive.add(seg)
            if len(done) >= 10_000 or k == len(values) - 1:
                cols = zip(*done, strict=True) if done else [[]] * len(_TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names)
                done = []


#: Settings of scans that read each file as a whole.
WHOLE = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50)}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the magic with what a record there would be, written once; size and digest of those that no other such record holds and that end before the file does.

    Offsets count from a file's start, so no scan may begin inside one: a plain text file would else be split."""
    own = spark.newSession()
    for name, value in WHOLE.items():
        own.conf.set(name, value)
    text = own.read.option("lineSep", MAGIC).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    held = staged(rows.mapInArrow(_candidates, CANDIDATES), "candidates")
    return spark.read.schema(held.schema).parquet(held.staged_path)


def reachable(found: DataFrame) -> DataFrame:
    """file, offset of the records on the chain from each file's start, by pointer jumping."""
    spark = found.sparkSession
    chain = staged(found.select(F.xxhash64("file").alias("f"), "offset", "next", (F.col("offset") == 0).alias("reached")), "chain")
    while True:
        targets = chain.where("reached").select("f", F.col("next").alias("offset"), F.lit(True).alias("hit")).distinct()
        jumps = chain.select("f", F.col("offset").alias("next"), F.col("next").alias("after"))
        out = chain.join(jumps, ["f", "next"], "left").join(targets, ["f", "offset"], "left")
        out = out.select("f", "offset", F.col("after").alias("next"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"), (~F.col("reached") & F.coalesce("hit", F.lit(False))).alias("new"))
        after = staged(out, "chain")
        dropped(spark, chain)
        chain = after
        if not after.where("new").limit(1).count():
            return chain.where("reached").select("f", "offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: columns of CANDIDATES."""
    found = candidates(spark, path)
    whole = found.where("payload_digest is not null")  # a reached record without one ends after its file does
    return whole.withColumn("f", F.xxhash64("file")).join(reachable(found), ["f", "offset"], "left_semi").select(found.columns)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads their records back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
