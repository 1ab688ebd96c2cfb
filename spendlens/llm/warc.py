"""Web archives: write pages as WARC records, and normalise monolithic gzip archives.

``write_archives`` stores one gzip stream per file, as many crawlers do. The
normaliser inflates such a stream once, in pieces, writes every record as a gzip
member of its own and an index with the offset and length of each member, so that
single records can be read without inflating what stands before them.

Files are written and read by Spark's own text and binary sources, so any store
that Spark reaches will do. The text source ends every row with a separator; here
that is the blank line which ends a WARC record anyway, and an empty gzip member,
which readers skip, in normalised archives.

Defined results: a NULL page is an empty payload; pages without an id are written,
are never referred to and refer to nothing; rows that repeat the id of the first
page with a payload are responses as well.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import by_batch, cut
from spendlens.plans.joins import lookup_join, spread_left_join
from spendlens.plans.store import new_folder, written

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 5000
END = "\r\n\r\n"
LEVEL = 4
PIECE = 2**16
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
INDEX = "archive string, seq int, offset long, length int"
MEMBER_HEAD = 24  # bytes before a member's body, its extra field included
ENTRY_BYTES = 32
SMALL_BYTES = 2**25  # what is broadcast at most


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a NULL value. Line breaks in a value would end the header."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def record_ids(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Payload, digest and record type of each page: ``page_id, url, payload, digest, record_type, refers_to``.

    Only digests and ids are shuffled to find the first page of each payload. A
    payload that very many pages share is spread over tasks when that is joined back.
    The revisits found are broadcast to the pages while their counted bytes are few.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload"))
    ids = cut(rows.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "digest"))
    firsts = (
        ids.groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
        .filter("_first < _last")
        .select("digest", "_first")
    )
    revisits = spread_left_join(ids, cut(firsts), ["digest"]).filter("page_id > _first")
    # Rows that repeat a page are one revisit each, but only one row of the lookup.
    revisits = cut(revisits.groupBy("page_id", "digest").agg(F.first("_first").alias("refers_to")))
    revisit = F.col("refers_to").isNotNull()
    return lookup_join(rows, revisits, ["page_id", "digest"], SMALL_BYTES).withColumn(
        "record_type", F.when(revisit, "revisit").otherwise("response")
    )


def warc_record(rows: DataFrame) -> DataFrame:
    """One column ``value``: the bytes of each record without the blank line at its end."""
    revisit = F.col("record_type") == "revisit"
    http = F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "utf-8")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", record_ids(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        # The standard has no field for the length of a payload that a revisit leaves out.
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, record_ids(F.col("refers_to")))),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(F.encode(header, "utf-8"), block).alias("value"))


def write_archives(rows: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Records into files of one gzip stream each, at most ``per_file`` records in a file."""
    options = {"compression": "gzip", "lineSep": END, "maxRecordsPerFile": per_file}
    warc_record(rows).select(F.col("value").cast("string")).write.options(**options).text(path)


def _pieces(content: bytes) -> Iterator[bytes]:
    """The inflated stream in bounded pieces; further members of the file are read on."""
    inflate = None
    for at in range(0, len(content), PIECE):
        rest = content[at : at + PIECE]
        while rest:
            inflate = inflate or zlib.decompressobj(31)
            yield inflate.decompress(rest, 16 * PIECE)
            rest = inflate.unconsumed_tail
            if inflate.eof:
                rest, inflate = inflate.unused_data, None
    if inflate:
        yield inflate.flush()
        if not inflate.eof:
            raise ValueError("the gzip stream ends early")


def split_records(content: bytes) -> Iterator[bytes]:
    """Records of a gzip file with their closing blank line, found by their stated length."""
    buffer, need = bytearray(), None
    for piece in _pieces(content):
        buffer += piece
        while True:
            if need is None:
                at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(parse_header(bytes(buffer[:at]))["content-length"]) + len(END)
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends within a record")


def parse_header(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record must begin with its version")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


class Record(NamedTuple):
    header: dict[str, str]
    payload: bytes


def parse_record(record: bytes) -> Record:
    header, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_header(header)
    block = rest[: int(fields["content-length"])]
    return Record(fields, block.partition(b"\r\n\r\n")[2])


def member(record: bytes) -> bytes:
    """A gzip member that states its own length and that of its content in an extra field named ``sl``."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    sizes = struct.pack("<II", MEMBER_HEAD + len(body) + 8, len(record))
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sH", 4 + len(sizes), b"sl", len(sizes)) + sizes
    return head + body + struct.pack("<II", zlib.crc32(record), len(record))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            # Two archives of one folder differ in the last part of their path.
            archive, rows = path.rsplit("/", 1)[-1], []
            for seq, record in enumerate(split_records(bytes(content))):
                rows.append((archive, seq, member(record)))
                if len(rows) == 256:
                    yield pd.DataFrame(rows, columns=["archive", "seq", "member"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["archive", "seq", "member"])


def _entries(batch: pd.DataFrame) -> pd.DataFrame:
    """Offsets and lengths of the members of whole files, from one stated length to the next."""
    rows = []
    for archive, content in zip(batch["archive"], batch["content"], strict=True):
        at, seq = 0, 0
        while at < len(content):
            (length,) = struct.unpack_from("<I", content, at + 16)
            rows.append((archive, seq, at, length))
            at, seq = at + length + len(EMPTY_MEMBER), seq + 1
    return pd.DataFrame(rows, columns=["archive", "seq", "offset", "length"])


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(path).select("path", "content")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.txt").withColumn("archive", F.regexp_extract("path", "archive=([^/]+)/", 1))


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive of ``source`` below ``target`` and return the index, which is written beside them.

    A file of ``source`` becomes the one file in ``target/archive=<its name>``, made by
    the task that inflates it. As members state their lengths, the index is then read
    off the new files without inflating anything again.
    """
    members = _files(spark, source, "*.gz").mapInPandas(_members, "archive string, seq int, member binary")
    ordered = members.sortWithinPartitions("archive", "seq").select("archive", F.col("member").cast("string").alias("value"))
    options = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
    ordered.write.partitionBy("archive").options(**options).text(target)
    index = _archives(spark, target).select("archive", "content").mapInPandas(by_batch(_entries), INDEX)
    return written(index, f"{target}.index")


def _read_members(batch: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for content, entries in zip(batch["content"], batch["entries"], strict=True):
        content = memoryview(content)
        for e in entries:
            packed = content[e["offset"] : e["offset"] + e["length"]]
            header, payload = parse_record(zlib.decompress(packed, 31))
            rows.append((header, payload))
    names = ["warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri", "warc-payload-digest"]
    frame = pd.DataFrame([[h.get(n) for n in names] for h, _ in rows], columns=[n.replace("-", "_") for n in names])
    return frame.assign(payload_length=[int(h["x-payload-length"]) for h, _ in rows], payload=[p for _, p in rows])


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Records of normalised archives, each inflated alone at the place that the index gives."""
    # An archive has a bounded number of records, so its entries fit in one row.
    entries = index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("entries"))
    if index.count() * ENTRY_BYTES <= SMALL_BYTES:
        entries = F.broadcast(entries)
    schema = (
        "warc_record_id string, warc_type string, warc_refers_to string, warc_target_uri string, "
        "warc_payload_digest string, payload_length long, payload binary"
    )
    return _archives(spark, path).join(entries, "archive").select("content", "entries").mapInPandas(by_batch(_read_members), schema)


def page_ids(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read the records back."""
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession)
    write_archives(with_revisits(pages), f"{folder}/crawl")
    index = normalise(spark, f"{folder}/crawl", f"{folder}/archives")
    return read_records(spark, f"{folder}/archives", index)
