"""WARC archives, index first: what is decided, copied or read goes by an index of byte ranges, never by payload.

Writing takes two passes. The first one writes every page once as a compressed record into a raw archive of its task
and gives an index row: file, offset, length, URL, digest. Which page of equal payloads is the response is then
decided over index rows alone, and no payload is ever shuffled. The second pass goes through the raw archives by
index rows dealt by place and sorted by offset: neighbouring ranges are coalesced into one read, responses are copied
as they are, and the other pages become revisit records. It writes the archives and their index.

Reading takes the rows of an index, all or any selection, deals them out by place, sorts them, reads coalesced
ranges and unpacks each record; a payload whose digest is not its record's raises an error.

Each record is a gzip member of its own, so that a range is all that is needed to read one. Archives lie in the folder of
spark.checkpoint.dir, written and read by executors through Arrow's file systems. A task writes under a name of its own,
and only index rows of ended tasks name it: what a lost executor has left is never read.

Cases: a null payload is an empty one; a null URL is left out of its record (control characters of others are percent-encoded
there; the index has all as they are); of equal payloads the largest key is the response, null keys last, and of
repeated keys any one; pages without a key are found by their record's id; payloads of any length are whole records; payloads
of fewer bytes than asked are all responses; an empty table gives an empty index; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, on_exit, shared_dir

#: Bytes of an archive whose records one task copies or reads together.
BLOCK = 8 << 20
#: A read goes on over a gap of so many bytes, up to so many bytes in all (a longer record is read alone).
GAP, MOST_READ = 64 << 10, 8 << 20
LEVEL = 1

# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_FIELD = "X-Page-Key"

RAW = "key {key}, url string, digest string, n_bytes long, record string, file string, offset long, length long"
INDEX = RAW + ", kind string, refers_to string"
RECORD = "key {key}, record string, kind string, refers_to string, digest string, n_bytes long, payload binary"


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _block(fields: list[tuple[str, object]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record_bytes(key: object, url: str | None, record: str, digest: str, n_bytes: int, date: str, payload: bytes | None = None, refers_to: str | None = None) -> bytes:
    """A record as one gzip member: a response with its payload, or without one a revisit of the record refers_to."""
    http = _block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n_bytes)], "HTTP/1.1 200 OK")
    url = url if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{record}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        (KEY_FIELD, key),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:uuid:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + len(payload or b"")),
    ]
    return zlib.compress(b"".join([_block(fields, VERSION), http, payload or b"", b"\r\n\r\n"]), LEVEL, 31)


def parsed(member: bytes) -> dict:
    """{kind, record, refers_to, key, digest, n_bytes, payload} of a record; the payload of a revisit is null and n_bytes what it says."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if lines[0] != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a record of {VERSION}: {head[:80]!r}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind, digest, bare = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">")
    said = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (digest_of(payload) != digest or len(payload) != said):
        raise ValueError(f"record {fields['warc-record-id']}: its payload is not the one of its digest")
    return {"kind": kind, "record": bare(fields["warc-record-id"]), "refers_to": bare(fields.get("warc-refers-to")), "key": fields.get(KEY_FIELD.lower()), "digest": digest, "n_bytes": said, "payload": payload if kind == "response" else None}


class Archive:
    """An archive under a new name, made with its first record."""

    def __init__(self, folder: str, kind: str) -> None:
        self.place, self.size, self.out = f"{folder}/{kind}-{uuid.uuid4().hex}.warc.gz", 0, None

    def add(self, member: bytes) -> tuple[str, int, int]:
        """(file, offset, length) of the record that is appended."""
        if self.out is None:
            from pyarrow.fs import FileSystem

            files, path = FileSystem.from_uri(self.place)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = files.open_output_stream(path, compression=None)
        self.out.write(member)
        self.size += len(member)
        return self.place, self.size - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def coalesced(ranges: list[tuple[str, int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[str, int, int, range]]:
    """(file, start, end, places) of the reads for ranges (file, offset, length) that are sorted."""
    first = 0
    while first < len(ranges):
        file, start, n = ranges[first]
        end, k = start + n, first + 1
        while k < len(ranges) and ranges[k][0] == file and 0 <= ranges[k][1] - start and ranges[k][1] <= end + gap and ranges[k][1] + ranges[k][2] - start <= most:
            end = max(end, ranges[k][1] + ranges[k][2])
            k += 1
        yield file, start, end, range(first, k)
        first = k


class Reader:
    """Byte ranges of archives; the last archive stays open."""

    def __init__(self) -> None:
        self.file, self.open = None, None

    def members(self, ranges: list[tuple[str, int, int]]) -> Iterator[tuple[int, bytes]]:
        """(place in ranges, bytes), by coalesced reads."""
        from pyarrow.fs import FileSystem

        for file, start, end, places in coalesced(ranges):
            if file != self.file:
                self.close()
                files, path = FileSystem.from_uri(file)
                self.file, self.open = file, files.open_input_file(path)
            self.open.seek(start)
            data = self.open.read(end - start)
            for k in places:
                at = ranges[k][1] - start
                yield k, data[at : at + ranges[k][2]]

    def close(self) -> None:
        if self.open is not None:
            self.open.close()


def _in_order(index: DataFrame) -> DataFrame:
    """index rows of a place in one task, sorted by offset. The number of tasks follows the bytes they read, which are many times those of the rows."""
    spark = index.sparkSession
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * BLOCK)))
    return index.withColumn("_block", F.floor(F.col("offset") / BLOCK)).repartition(parts, "file", "_block").sortWithinPartitions("file", "offset").drop("_block")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _arrow(told: str, key: pa.DataType) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds.get(t, key)) for n, t in (x.split() for x in told.split(", "))])


def _key_type(df: DataFrame, key: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)


def raw_index(pages: DataFrame, key: str, url: str, text: str, folder: str, date: str) -> DataFrame:
    """Every page as a response in the raw archives, and the index of these as a written table."""
    name, kind = _key_type(pages, key)
    schema = _arrow(RAW, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archive(folder, "raw")
        try:
            for batch in batches:
                rows = []
                for k, u, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, record = (x or "").encode(), str(uuid.uuid4())
                    digest = digest_of(payload)
                    rows.append((k, u, digest, len(payload), record, *out.add(record_bytes(k, u, record, digest, len(payload), date, payload))))
                yield _batch(rows, schema)
        finally:
            out.close()

    return durable(pages.select(F.col(key), F.col(url), F.col(text)).mapInArrow(run, RAW.format(key=name)), "warc-raw")


def decided(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """index with refers_to: null for responses, else the record of the response with an equal payload."""
    equal = index.filter(F.col("n_bytes") >= least_bytes)
    tops = durable(equal.groupBy("digest").agg(F.max(F.struct("key", "record"))["record"].alias("top"), F.count("*").alias("n")), "warc-equal")
    refers = F.when(F.col("top") != F.col("record"), F.col("top"))
    met = join_counted(equal, tops, "digest").select(*index.columns, refers.alias("refers_to"))
    return met.unionByName(index.filter(F.col("n_bytes") < least_bytes).withColumn("refers_to", F.lit(None).cast("string")))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The index (key, url, digest, n_bytes, record, file, offset, length, kind, refers_to) of new archives with a record for each page.

    Of pages with equal payloads of least_bytes or more, that of the largest key is a response and the others revisit it."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark, qualified=True)}/docloom/warc-{uuid.uuid4().hex}"
    on_exit(spark, folder)
    name, kind = _key_type(pages, key)
    chosen = durable(decided(raw_index(pages, key, url, text, folder, date), least_bytes), "warc-decided")
    schema = _arrow(INDEX, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, out = Reader(), Archive(folder, "pages")
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(f.name).to_pylist() for f in schema if f.name != "kind"), strict=True))
                done = []
                for row in (r for r in rows if r[8] is not None):
                    k, u, digest, n, record, *_, refers_to = row
                    done.append((*row[:5], *out.add(record_bytes(k, u, record, digest, n, date, None, refers_to)), "revisit", refers_to))
                copied = [r for r in rows if r[8] is None]
                for at, member in source.members([r[5:8] for r in copied]):
                    done.append((*copied[at][:5], *out.add(member), "response", None))
                yield _batch(done, schema)
        finally:
            source.close()
            out.close()

    return durable(_in_order(chosen).mapInArrow(run, INDEX.format(key=name)), "warc-index")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """(key, record, kind, refers_to, digest, n_bytes, payload) of the records that the rows of index name; no payload if it isn't asked for."""
    name, kind = _key_type(index, "key")
    schema = _arrow(RECORD, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Reader()
        try:
            for batch in batches:
                done, held = [], 0
                for _, member in source.members(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                    found = parsed(member)
                    if not payload:
                        found["payload"] = None
                    done.append(tuple(found[f.name] for f in schema))
                    held += len(found["payload"] or b"")
                    if held > MOST_READ:
                        yield _batch(done, schema)
                        done, held = [], 0
                yield _batch(done, schema)
        finally:
            source.close()

    found = _in_order(index.select("key", "file", "offset", "length")).select("file", "offset", "length").mapInArrow(run, RECORD.format(key="string"))
    return found.withColumn("key", F.col("key").cast(name))


def resolved(records: DataFrame) -> DataFrame:
    """records with the key of the response that a revisit refers to as refers_key, and that one's digest and size; records: a written table."""
    known = records.filter("kind = 'response'").select(F.col("record").alias("refers_to"), F.col("key").alias("refers_key"), F.col("digest").alias("of_digest"), F.col("n_bytes").alias("of_bytes"))
    revisits = records.filter("kind = 'revisit'")
    named = durable(revisits.groupBy("refers_to").agg(F.count("*").alias("n")).join(known, "refers_to"), "warc-referred")
    met = join_counted(revisits.drop("digest", "n_bytes"), named, "refers_to").withColumnsRenamed({"of_digest": "digest", "of_bytes": "n_bytes"})
    first = records.filter("kind = 'response'").withColumn("refers_key", F.lit(None).cast(records.schema["key"].dataType))
    return first.unionByName(met)
