"""WARC archives with a two-level capture index.

Records are gzip members of their own in WARC files that Spark's writer commits. An
index line for each capture, sorted by a key with the host reversed, goes into blocks,
again gzip members, and a sparse directory keeps each block's first key. A lookup is a
binary search in the directory, a range read of one block, a binary search in it and a
range read of the record.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, written

#: Payloads under this size are always stored, as a reference would save little.
REVISIT_BYTES = 1000
#: The capture time of tables that hold none.
DATE = "2024-01-01T00:00:00Z"
#: A directory has no more entries than this; blocks grow instead.
MOST_BLOCKS = 200_000
#: Ranges closer than this are read at once, up to so many bytes.
GAP, READ = 1 << 16, 1 << 23
#: Bytes of records, or of index lines, that a task works on.
TASK_BYTES = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


# --- records -----------------------------------------------------------------------


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def target_uri(url: str | None) -> str:
    """The URL as a header value: white space, controls and non-ASCII are escaped."""
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~") or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record of a WARC 1.1 file; a revisit has the HTTP headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload), names in lower case."""

    def fields(lines: list[str]) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    at = raw.index(b"\r\n\r\n")
    head = raw[:at].decode().split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {head[0][:80]!r}")
    warc = fields(head[1:])
    block = raw[at + 4 : at + 4 + int(warc["content-length"])]
    at = block.index(b"\r\n\r\n")
    return warc, fields(block[:at].decode().split("\r\n")[1:]), block[at + 4 :]


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is 0, as the size of what is under 16 MB ends; to
    larger ones an empty member is added."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out.endswith(b"\0") else out + _EMPTY


# --- files -------------------------------------------------------------------------


def write_members(members: DataFrame, path: str, per_file: int | None = None) -> None:
    """Writes a column of gzip members as files of concatenated members.

    The text writer puts a separator after each row; as members end with a zero byte,
    that byte serves as the separator and nothing is added.
    """
    writer = members.select(F.expr("cast(substring(member, 1, length(member) - 1) as string)").alias("value")).write.option("lineSep", "\0")
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.text(path)


def _file(uri: str):
    """A file system and a path of it for what Spark calls uri."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def scan_members(uri: str, chunk: int = 1 << 20, most: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, beginning) of each member that isn't empty: `most` bytes of what
    it holds at least, where it has them. Longer ones are read on but not kept."""
    fs, path = _file(uri)
    with fs.open_input_stream(path) as f:
        read, data, inflate, out, start, size = 0, b"", None, [], 0, 0
        while True:
            if not data:
                data = f.read(chunk)
                read += len(data)
                if not data:
                    break
            if inflate is None:
                inflate, out, start, size = zlib.decompressobj(31), [], read - len(data), 0
            got = inflate.decompress(data)
            if size < most:
                out.append(got)
                size += len(got)
            data = inflate.unused_data
            if inflate.eof:
                content = b"".join(out)
                if content:
                    yield start, read - len(data) - start, content
                inflate = None
        if inflate is not None:
            raise EOFError(f"{uri} ends within a member")


def read_ranges(uri: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (offset, length), sorted by offset; near ranges share a read."""
    fs, path = _file(uri)
    with fs.open_input_file(path) as f:
        i = 0
        while i < len(ranges):
            start, j = ranges[i][0], i
            end = sum(ranges[i])
            while j + 1 < len(ranges) and ranges[j + 1][0] - end <= GAP and sum(ranges[j + 1]) - start <= READ:
                j += 1
                end = max(end, sum(ranges[j]))
            data = f.read_at(end - start, start)
            for offset, length in ranges[i : j + 1]:
                yield data[offset - start : offset - start + length]
            i = j + 1


def _parts(spark, size: int) -> int:
    """Partitions for so many bytes of records that the rows only point to, which Spark
    can't see when it sizes partitions itself; no fewer than it shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path")


# --- archive -----------------------------------------------------------------------


def deduplicated(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds payload_digest, revisit and refers_to. Of pages with equal payloads of
    REVISIT_BYTES at least, those with the largest page_id are stored and the others
    refer to it; groups are found on digests, so no payload is shuffled for it unless
    the groups are too many to broadcast. Null html is empty; null ids never name a
    group."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.withColumns({"payload_digest": F.sha1(F.encode(text, "UTF-8")), "_bytes": F.octet_length(text)})
    groups = own.filter(F.col("_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    groups = broadcast_if_small(written(groups, "warc-groups"), 100_000)
    joined = own.join(groups, "payload_digest", "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.withColumn("revisit", again).withColumn("refers_to", F.when(again, F.col("refers_to"))).drop("_bytes")


def write_archive(pages: DataFrame, path: str, html_col: str = "html", per_file: int = 4000) -> None:
    """A WARC record for each row of pages (page_id, url, html), in files of `per_file`
    records at most under path."""
    rows = deduplicated(pages.select("page_id", "url", F.col(html_col).alias("html"))).select("page_id", "url", "html", "payload_digest", "refers_to", "revisit")

    def build(batches):
        for b in batches:
            out = []
            for page_id, url, html, digest, refers_to, revisit in b.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                out.append(member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, bool(revisit))))
            yield pd.DataFrame({"member": out})

    # ids pass as text: pandas would turn a column with nulls into floats
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    write_members(rows.mapInPandas(build, "member binary"), path, per_file)


# --- index -------------------------------------------------------------------------


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query."""
    uri = target_uri(url)
    scheme, found, rest = uri.partition("://")
    if not found:
        return uri
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].partition(":")
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + rest[cut:].partition("#")[0]


def captures(spark, archive: str) -> DataFrame:
    """(key, page_id, file, offset, length) of each record of the archive's files."""

    def read(batches):
        for b in batches:
            for uri in b["path"]:
                out = []
                for offset, length, raw in scan_members(uri):
                    head = dict(x.split(": ", 1) for x in raw[: raw.index(b"\r\n\r\n")].decode().split("\r\n")[1:])
                    page_id = _page_of(head["WARC-Record-ID"])
                    out.append((surt(head["WARC-Target-URI"]), -1 if page_id is None else page_id, uri, offset, length))
                yield pd.DataFrame(out, columns=["key", "page_id", "file", "offset", "length"])

    return _files(spark, archive).mapInPandas(read, "key string, page_id long, file string, offset long, length long")


class Directory:
    """The first (key, page) of every block, with where the block lies."""

    def __init__(self, rows: Iterable[tuple[str, int, str, int, int]]):
        rows = sorted(rows)
        self.size = sum(r[4] for r in rows)
        self.first = [(r[0], r[1]) for r in rows]
        self.place = [r[2:] for r in rows]

    def blocks(self, key: tuple[str, int]) -> Iterator[int]:
        """Numbers of the blocks that may hold the key, in order."""
        n = max(0, bisect.bisect_left(self.first, key) - 1)
        while n < len(self.first) and self.first[n] <= key:
            yield n
            n += 1


def build_index(spark, archive: str, path: str, block_lines: int = 256) -> Directory:
    """Writes the sorted blocks under path and returns their directory, of MOST_BLOCKS
    entries about: larger archives get longer blocks."""
    lines = written(captures(spark, archive), "warc-captures")
    size = max(block_lines, -(-lines.count() // MOST_BLOCKS))

    def pack(batches):
        kept: list[str] = []

        def packed(rows):
            return pd.DataFrame({"member": [member("\n".join(rows).encode())]})

        for b in batches:
            kept += [json.dumps(row) for row in zip(b["key"], *(b[c].tolist() for c in ("page_id", "file", "offset", "length")))]
            while len(kept) >= size:
                yield packed(kept[:size])
                kept = kept[size:]
        if kept:
            yield packed(kept)

    width = lines.agg(F.sum(F.length("key") + F.length("file") + 40)).first()[0] or 0
    ordered = lines.repartitionByRange(_parts(spark, width), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    write_members(ordered.mapInPandas(pack, "member binary"), path)

    def first(batches):
        for b in batches:
            for uri in b["path"]:
                out = []
                for offset, length, raw in scan_members(uri):
                    key, page_id = json.loads(raw[: (raw + b"\n").index(b"\n")])[:2]
                    out.append((key, page_id, uri, offset, length))
                yield pd.DataFrame(out, columns=["key", "page_id", "file", "offset", "length"])

    rows = _files(spark, path).mapInPandas(first, "key string, page_id long, file string, offset long, length long")
    return Directory(tuple(r) for r in rows.toLocalIterator())


def locate(wanted: DataFrame, directory: Directory) -> DataFrame:
    """(file, offset, length) of each capture of the wanted (key, page_id), which are
    searched in the index's order, so that a task reads a block once."""
    shared = wanted.sparkSession.sparkContext.broadcast(directory)

    def find(batches):
        directory, number, lines = shared.value, None, []
        for b in batches:
            out = []
            for key in zip(b["key"], b["page_id"].tolist()):
                for n in directory.blocks(key):
                    if n != number:
                        file, offset, length = directory.place[n]
                        raw = zlib.decompressobj(31).decompress(next(read_ranges(file, [(offset, length)])))
                        number, lines = n, [json.loads(x) for x in raw.decode().split("\n")]
                    at = bisect.bisect_left(lines, [*key])
                    while at < len(lines) and tuple(lines[at][:2]) == key:
                        out.append(lines[at][2:])
                        at += 1
            yield pd.DataFrame(out, columns=["file", "offset", "length"])

    ordered = wanted.repartitionByRange(_parts(wanted.sparkSession, directory.size), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInPandas(find, "file string, offset long, length long")


def fetch(places: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records
    at the places, by range reads in the order of the files."""

    def read(batches):
        for b in batches:
            out = []
            for file, own in b.groupby("file", sort=False):
                ranges = list(zip(own["offset"].tolist(), own["length"].tolist()))
                for raw in read_ranges(file, ranges):
                    warc, http, payload = parse_record(zlib.decompressobj(31).decompress(raw))
                    digest, revisit = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file}: {warc['warc-record-id']} differs from its digest")
                    refers_to = _page_of(warc["warc-refers-to"]) if revisit else None
                    size = int(http["content-length"]) if revisit else len(payload)
                    out.append((_page_of(warc["warc-record-id"]), size, digest, warc["warc-type"], refers_to))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)

    places = written(places, "warc-places")
    size = places.agg(F.sum("length")).first()[0] or 0
    ordered = places.repartitionByRange(_parts(places.sparkSession, size), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Archives all pages, indexes the archive, looks every page up and reads its record
    back: one row for each row of pages, repeated ones and null ids included."""
    spark = pages.sparkSession
    archive, index = scratch(spark, "warc"), scratch(spark, "warc-index")
    write_archive(pages, archive, html_col)
    directory = build_index(spark, archive, index)

    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return pd.Series([surt(u) for u in urls], dtype=object)

    wanted = pages.select(key("url").alias("key"), F.coalesce("page_id", F.lit(-1).cast("long")).alias("page_id")).distinct()
    return fetch(locate(wanted, directory))
