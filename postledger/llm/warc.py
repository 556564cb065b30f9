"""WARC archives with a two-level capture index.

**Archives.**  Tasks write gzip members, one per record, into files of their own and report
where each record lies.  A payload is stored once: of equal payloads the one of the
smallest page id is a response record, the others are revisit records that name it and
keep its digest and length.

**Index.**  Captures are sorted by their key, the host name reversed and then the path, and
written as compressed blocks of lines.  Beside each index file lies its sparse directory,
the first key and the place of every block; above them is a list with one row per index
file.  A lookup sorts what is wanted by key, binary-searches the list, then a directory,
range-reads the one block and binary-searches its lines.  The records themselves are then
range-read in the order in which they lie, neighbours together.

Only keys and places are shuffled, except that payloads are dealt out once, by their
digest, to find equal ones; adaptive execution splits a digest of very many pages.  A task
that dies leaves files that nothing refers to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.llm.shared import written

_RESPONSE, _REVISIT = "response", "revisit"
_PAGE = "urn:x-page:"
_SLICE = 256
# Neighbouring records are read together up to this many bytes.
_READ = 8 << 20


@dataclass(frozen=True)
class Archive:
    """``folder``: shared by all executors.  ``least_revisit``: bytes of a payload that is
    worth a revisit.  ``file_bytes``: after which a task begins another archive.  ``lines``:
    per index block."""

    folder: str
    least_revisit: int = 0
    file_bytes: int = 1 << 30
    lines: int = 1000

    def part(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def surt(url: Column) -> Column:
    """The sort key of a URL: host labels reversed, then what follows, without the fragment.

    White space and control characters are written as %20, so that keys fit into lines.  A
    null URL has the empty key.
    """
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[\s\p{Cntrl}]", "%20")
    rest = F.regexp_replace(F.regexp_replace(clean, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(labels, F.lit(")"), path))


def capture_key(key: Column, page: Column) -> Column:
    """Key and page id as one string that sorts like the two."""
    number = F.lpad((page.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(number, F.lit("")))


def _record(kind: str, page, url: str, payload: bytes | None, digest: str, length: int, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_PAGE}{'' if page is None else page}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == _REVISIT:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_PAGE}{'' if refers is None else refers}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _page(value: str | None) -> int | None:
    number = value.strip("<>").removeprefix(_PAGE) if value else ""
    return int(number) if number else None


def parse(record: bytes) -> dict:
    """Page, URL, payload, digest, length, kind and referred page of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == _RESPONSE and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload": payload if kind == _RESPONSE else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields.get("WARC-Refers-To")),
    }


class _Files:
    """Output files of one task: ``put`` appends and tells file, offset and length."""

    def __init__(self, folder: str, ending: str, limit: int):
        self.files, self.folder = _open(folder)
        self.ending, self.limit, self.stream, self.name, self.at = ending, limit, None, "", 0
        self.files.create_dir(self.folder, recursive=True)

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at >= self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.ending}", 0
            self.stream = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.stream.write(data)
        place = self.name, self.at, len(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_CAPTURES = pa.schema(
    [("capture", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())]
)
_FILES = pa.schema([("first", pa.string()), ("file", pa.string()), ("lines", pa.int64())])
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def write_records(pages: DataFrame, archive: Archive) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); tells where they lie.

    A null html is the empty payload.  Rows with the smallest page id of a payload are
    responses, so a repeated row of it is a response again.  Rows without an id are
    revisits, unless no equal payload has one.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    firsts = (
        rows.filter(F.octet_length("html") >= archive.least_revisit)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("of", "first")
    )
    told = rows.join(firsts, F.col("digest") == F.col("of"), "left").select(
        F.col("page_id").alias("page"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\p{Cntrl}]", "%20").alias("url"),
        capture_key(surt(F.col("url")), F.col("page_id")).alias("capture"),
        "digest",
        "first",
        F.octet_length("html").cast("long").alias("size"),
        (F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("again"),
        F.when(F.col("of").isNull() | F.col("page_id").eqNullSafe(F.col("first")), F.col("html")).alias("html"),
    )
    folder, limit = archive.part("warc"), archive.file_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(folder, ".warc.gz", limit)
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                places = []
                for r in batch.slice(begin, _SLICE).to_pylist():
                    kind, payload = (_REVISIT, None) if r["again"] else (_RESPONSE, r["html"].encode("utf-8"))
                    record = _record(kind, r["page"], r["url"], payload, base32(r["digest"]), r["size"], r["first"])
                    file, offset, length = out.put(_gzip(record))
                    places.append({"capture": r["capture"], "file": file, "offset": offset, "length": length, "record_type": kind})
                yield _batch(places, _CAPTURES)
        out.close()

    return written(told.mapInArrow(write, _ddl(_CAPTURES)), archive.part("captures"))


def write_index(captures: DataFrame, archive: Archive) -> DataFrame:
    """Writes the sorted blocks and their directories; gives the list of index files."""
    folder, lines = archive.part("index"), archive.lines

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, held, total = _Files(folder, ".cdx.gz", 1 << 62), [], [], 0

        def flush() -> None:
            data = "\n".join(capture + " " + json.dumps(place) for capture, place in held)
            _, offset, length = out.put(_gzip(data.encode("utf-8")))
            directory.append((held[0][0], offset, length))
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                held.append((r["capture"], [r["file"], r["offset"], r["length"], r["record_type"]]))
                total += 1
                if len(held) == lines:
                    flush()
        if held:
            flush()
        out.close()
        if directory:
            with out.files.open_output_stream(f"{out.folder}/{out.name}.dir", compression=None) as beside:
                beside.write(json.dumps(directory).encode("utf-8"))
            yield _batch([{"first": directory[0][0], "file": out.name, "lines": total}], _FILES)

    ordered = captures.repartitionByRange("capture", "file", "offset").sortWithinPartitions("capture", "file", "offset")
    return written(ordered.mapInArrow(write, _ddl(_FILES)), archive.part("index-files"))


class Reader:
    """Finds captures in the index files of an archive, given their sorted list."""

    def __init__(self, folder: str, listed: list[tuple[str, str]]):
        self.files, self.folder = _open(folder)
        self.firsts, self.names = [f for f, _ in listed], [n for _, n in listed]
        self.directory: tuple[int, list] = (-1, [])
        self.block: tuple[tuple[int, int], list] = ((-1, -1), [])

    def _read(self, name: str, offset: int | None = None, length: int | None = None) -> bytes:
        with self.files.open_input_file(f"{self.folder}/{name}") as source:
            return source.read() if offset is None else source.read_at(length, offset)

    def _directory(self, file: int) -> list:
        if self.directory[0] != file:
            self.directory = file, json.loads(self._read(self.names[file] + ".dir"))
        return self.directory[1]

    def _lines(self, file: int, block: int) -> list[tuple[str, str]]:
        if self.block[0] != (file, block):
            _, offset, length = self._directory(file)[block]
            text = zlib.decompress(self._read(self.names[file], offset, length), 31).decode("utf-8")
            # A capture is a key without blanks, a blank and a number; its place follows.
            self.block = (file, block), [(" ".join(x[:2]), x[2]) for x in (line.split(" ", 2) for line in text.split("\n"))]
        return self.block[1]

    def find(self, capture: str) -> Iterator[list]:
        """The places of all records of a capture."""
        file = max(0, bisect.bisect_left(self.firsts, capture) - 1)
        while file < len(self.names) and self.firsts[file] <= capture:
            directory = self._directory(file)
            block = max(0, bisect.bisect_left(directory, capture, key=lambda d: d[0]) - 1)
            while block < len(directory) and directory[block][0] <= capture:
                lines = self._lines(file, block)
                at = bisect.bisect_left(lines, capture, key=lambda line: line[0])
                while at < len(lines) and lines[at][0] == capture:
                    yield json.loads(lines[at][1])
                    at += 1
                block += 1
            file += 1


def lookup(wanted: DataFrame, archive: Archive) -> DataFrame:
    """The places of all records of the wanted captures (``capture``, as ``capture_key`` gives).

    Wanted captures are sorted, so that a task goes through neighbouring blocks once.  What
    every task gets is the list of index files, a row for each task that wrote the index.
    """
    spark = wanted.sparkSession
    rows = spark.read.parquet(archive.part("index-files")).select("first", "file").collect()
    listed, folder = spark.sparkContext.broadcast(sorted(map(tuple, rows))), archive.part("index")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, listed.value)
        for batch in batches:
            yield _batch(
                [
                    {"capture": c, "file": file, "offset": offset, "length": length, "record_type": kind}
                    for c in batch["capture"].to_pylist()
                    for file, offset, length, kind in reader.find(c)
                ],
                _CAPTURES,
            )

    keys = wanted.select("capture").distinct().repartitionByRange("capture").sortWithinPartitions("capture")
    return keys.mapInArrow(find, _ddl(_CAPTURES))


def read_records(places: DataFrame, archive: Archive, payload: bool = True) -> DataFrame:
    """The records at ``places`` (file, offset, length), read in the order in which they lie."""
    folder = archive.part("warc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for batch in batches:
            run: list[tuple[str, int, int]] = []

            def load() -> list[dict]:
                file, start, _ = run[0]
                end = run[-1][1] + run[-1][2]
                with files.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(end - start, start)
                found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in run]
                run.clear()
                return found if payload else [f | {"payload": None} for f in found]

            for place in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                file, offset, length = place
                if run and (file != run[0][0] or offset != run[-1][1] + run[-1][2] or offset + length - run[0][1] > _READ or len(run) >= _SLICE):
                    yield _batch(load(), _RECORDS)
                run.append(place)
            if run:
                yield _batch(load(), _RECORDS)

    ordered = places.select("file", "offset", "length").repartitionByRange("file", "offset")
    return ordered.sortWithinPartitions("file", "offset").mapInArrow(read, _ddl(_RECORDS))


def round_trip(pages: DataFrame, archive: Archive) -> DataFrame:
    """Writes ``pages`` as records with an index and reads every page back through the index.

    One row per row of ``pages``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to.  An empty table writes nothing and gives an empty result; other columns are
    not read.
    """
    captures = write_records(pages, archive)
    write_index(captures, archive)
    wanted = pages.select(capture_key(surt(F.col("url")), F.col("page_id")).alias("capture"))
    return read_records(lookup(wanted, archive), archive, payload=False).drop("payload")


def open_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """All records of a written archive."""
    return read_records(spark.read.parquet(archive.part("captures")), archive)


def round_trip_sql() -> str:
    """What the registered query must equal.  Five hex digits are four base32 characters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = "CAST('0x' || substr(digest, 5 * (k // 4) + 1, 5) AS BIGINT)"
    return f"""
    WITH digests AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
    ), firsts AS (
        SELECT digest, min(page_id) AS first, count(*) > 1 AS several FROM digests GROUP BY digest
    )
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda k:
               substr('{alphabet}', CAST(({five} >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
           CASE WHEN several AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN several AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM digests JOIN firsts USING (digest)
    """
