"""Deterministic sharded WARC archives.

Pages are dealt by exact ranges of page_id and sorted; every range is written by one task as
gzip members, one a record, in files that roll once their compressed size passes a bound.
Headers, block and payload digests are made anew from the page.  Each attempt writes under
names of its own; the rows that it returns are the manifest, which Spark's commit takes from
one attempt of each task only.  A second job renames the manifest's files to their final
names (doing nothing where that has been done), and the manifest is published last.  Ranges,
order, headers and members depend on the pages alone, so reruns give equal bytes.

Of equal payloads of at least ``least`` bytes, the record with the smallest page_id is the
response and the others are revisits that refer to it.

Files lie in the shared folder, whose path is qualified by Spark's file system first; any store
that pyarrow opens by URI will do.

Defined cases: null html is an empty payload; payloads of any length are one record each; pages
without page_id come first, never lend their id to a revisit unless all equal payloads lack one
(then they are responses); of rows with equal page_id and payload the first is the response, the
others revisit that same page_id; records of a page_id with several payloads are told apart by
their digests; an empty table gives an empty manifest and an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import Ranges, cut, deal, map_rows, scratch, spread_join
from grainmill.session import qualified

QUERY = "op3_warc_shards"

#: Compressed bytes after which a file rolls, payload bytes in a range, and from which payloads are revisited.
ROLL_BYTES, RANGE_BYTES, LEAST = 64 << 20, 128 << 20, 100
LEVEL = 6
#: Record versions and the one date, so that archives depend on the pages only.
VERSION, DATE = "WARC/1.1", "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "part int, seq int, name string, temp string, records long, bytes long, sha256 string"


def _record_id(page_id: int | None, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{n}')}>"


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, n: int = 0) -> bytes:
    """One record, not compressed: response with the payload, or revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = _digest(payload)
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, n)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or f'urn:page:{page_id}', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Roller:
    """Writes members into files under temporary names; finished ones are manifest rows."""

    def __init__(self, folder: str, part: int, roll_bytes: int) -> None:
        self.store, self.folder = _open(folder)
        self.part, self.roll, self.seq, self.attempt = part, roll_bytes, 0, uuid.uuid4().hex
        self.out = None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temp = f"temp/part-{self.part:06d}-{self.seq:05d}.{self.attempt}"
            self.store.create_dir(f"{self.folder}/temp", recursive=True)
            self.out = self.store.open_output_stream(f"{self.folder}/{self.temp}", compression=None)
            self.sum, self.size, self.records = hashlib.sha256(), 0, 0
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll:
            yield from self.done()

    def done(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.part, self.seq, f"part-{self.part:06d}-{self.seq:05d}.warc.gz", self.temp, self.records, self.size, self.sum.hexdigest()
            self.seq += 1


def decided(small: DataFrame) -> DataFrame:
    """Of rows (page_id, tie, digest): one row (page_id, tie, digest, refers_to) for each page and payload of a class that
    holds a revisit, with the class's smallest page_id.  Small columns only; the rows of a large class are spread."""
    own = small.where("digest is not null").select("page_id", "tie", "digest")
    classes = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    found = spread_join(own, classes.select("digest", "refers_to"), "digest", own.count())
    return found.groupBy("page_id", "tie", "digest").agg(F.min("refers_to").alias("refers_to"))


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, least: int = LEAST) -> DataFrame:
    """Write archives of pages (page_id, url, html) under ``folder``; returns the published manifest."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("tie", F.xxhash64("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256))
    small = cut(own.select("page_id", "tie", digest.alias("digest"), (F.octet_length("html") + 256).alias("w")), "payloads")
    ranges = Ranges(small, "page_id", "tie", "w", range_bytes, least=2 * spark.sparkContext.defaultParallelism)
    nothing = F.lit(None).cast("string")
    rows = own.select("page_id", "tie", F.lit(1).alias("kind"), "url", "html", nothing.alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    known = decided(small).select("page_id", "tie", F.lit(0).alias("kind"), nothing.alias("url"), nothing.alias("html"), "digest", "refers_to")
    dealt = deal(ranges.with_part(rows.union(known)), "part", ranges.parts)
    dealt = dealt.sortWithinPartitions("part", F.asc_nulls_first("page_id"), "tie", "kind", F.xxhash64("url"))

    def work(found: Iterator[tuple]) -> Iterator[tuple]:
        roller, now, revisits, seen = None, None, {}, {}
        for page_id, tie, kind, url, html, digest, refers_to, part in found:
            if roller is None or roller.part != part:
                if roller:
                    yield from roller.done()
                roller = Roller(folder, part, roll_bytes)
            if (page_id, tie) != now:
                now, revisits, seen = (page_id, tie), {}, {}
            if kind == 0:
                revisits[digest] = refers_to
                continue
            payload = html.encode("utf-8", "replace")
            own = hashlib.sha256(payload).hexdigest()
            n = seen[own] = seen.get(own, -1) + 1
            to = revisits.get(own)
            yield from roller.add(member(record(page_id, url, payload, to, to is not None and (to != page_id or n > 0), n)))
        if roller:
            yield from roller.done()

    written = f"{folder}/written"
    map_rows(dealt.select("page_id", "tie", "kind", "url", "html", "digest", "refers_to", "part"), work, MANIFEST).write.parquet(written)
    manifest = spark.read.parquet(written)

    def commit(found: Iterator[tuple]) -> Iterator[tuple]:
        store, base = _open(folder)
        for row in found:
            name, temp, size = row[2], row[3], row[5]
            if store.get_file_info(f"{base}/{name}").size != size:
                store.move(f"{base}/{temp}", f"{base}/{name}")
            yield row

    map_rows(manifest, commit, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one gzip member at a time."""
    machine, held, plain = zlib.decompressobj(31), b"", bytearray()
    while True:
        data = held or stream.read(1 << 20)
        if not data:
            break
        plain += machine.decompress(data)
        held = machine.unused_data
        if machine.eof:
            head, _, block = bytes(plain).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            yield dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:]), block[:-4]
            machine, plain = zlib.decompressobj(31), bytearray()
    if plain:
        raise ValueError("an archive ends within a record")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to, warc.

    Digests are checked: of blocks always, and of payloads where the record holds one.
    """
    folder = qualified(manifest.sparkSession, folder)

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        store, base = _open(folder)
        for (name,) in rows:
            with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for head, block in records_of(stream):
                    if head["WARC-Block-Digest"] != _digest(block):
                        raise ValueError(f"{name}: a block differs from its digest")
                    payload = block.partition(b"\r\n\r\n")[2]
                    if head["WARC-Type"] == "response" and head["WARC-Payload-Digest"] != _digest(payload):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
                    page, to = head["X-Page-Id"], head.get("X-Refers-To-Page")
                    yield int(page) if page else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(to) if to else None, name

    names = manifest.select("name").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism))
    return map_rows(names, work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as the archives have it."""
    folder = scratch(spark, "warc")
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder).drop("warc")


#: What the archives must give back, in DuckDB's SQL.
ORACLE_SQL = f"""
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least_id END AS refers_to
FROM (
    SELECT page_id, html, least_id, strlen(html) >= {LEAST} AND least_id IS NOT NULL AND (page_id IS DISTINCT FROM least_id OR place > 1) AS again
    FROM (
        SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id,
            row_number() OVER (PARTITION BY coalesce(html, ''), page_id) AS place
        FROM pages
    )
)
"""
