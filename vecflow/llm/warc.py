"""WARC 1.1 archives: a writer and a Python data source.

Each record is a gzip member of its own. ``response`` records hold an HTTP response whose body is
the payload; ``revisit`` records hold the HTTP headers only and refer to the record with the same
payload. Beside each archive the writer leaves an index (Parquet: offset and bytes of each record)
and, in a manifest for all archives, where splits begin: planning reads a number per split, and a
task steps over records without inflating them.

Archives from elsewhere have no index. Each is read by one task as a stream, in blocks: headers
come first, an unwanted block is sought over (plain files) or inflated and let go (gzip), so time
grows with the file's size and memory with one wanted record. With option resync=true a gzip file
is split every splitBytes bytes: a task starts at the first gzip member from its offset on that
begins a record. That is wrong for archives that hold archives, so it is off by default.

The source takes over filters on the header columns, where the session pushes filters to Python
sources, and builds payloads only of records that pass (and of none with option payload=false).
resource and conversion records are all payload; other types have none. A file that ends within a
record ends with the record before. Where a gzip member is damaged or headers are too long, the record
is lost and reading goes on at the next member, in a plain file at the next line, that begins a record;
with option damaged=fail that is an error instead. In archives with an index it is always one, as the
index tells where each record is. An empty table gives an archive folder without records.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .skew import join_hot
from .storage import file_size, list_files, new_file, opened, read_bytes, stored

END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, http_length long, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
BARE = {"record_id", "refers_to"}
SPLIT_BYTES, RESYNC_BYTES = 32 << 20, 256 << 20
#: Bytes read, and inflated, at once; headers longer than HEADER_BYTES are no headers.
CHUNK, HEADER_BYTES = 256 << 10, 1 << 20
#: Payloads shorter than this are never written as revisits.
SHORTEST_REVISIT = 100


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def clean_uri(uri: str | None) -> str | None:
    """A header value can't hold line ends."""
    return None if uri is None else " ".join(uri.split())


def _writer(uri: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        name = uuid.uuid4().hex
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        offsets, sizes, at = [], [], 0
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        with new_file(f"{uri}/{name}.warc.gz") as f:

            def put(raw: bytes) -> None:
                nonlocal at
                data = member(raw)
                f.write(data)
                offsets.append(at)
                sizes.append(len(data))
                at += len(data)

            put(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": now, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            while batch is not None:
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
                    revisit = row["refers_to"] is not None
                    put(
                        record(
                            {
                                "WARC-Type": "revisit" if revisit else "response",
                                "WARC-Record-ID": f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>",
                                "WARC-Date": now,
                                "WARC-Target-URI": clean_uri(row["url"]),
                                "WARC-Payload-Digest": f"sha256:{row['digest']}",
                                "WARC-Refers-To": f"<urn:page:{row['refers_to']}>" if revisit else None,
                                "WARC-Profile": REVISIT if revisit else None,
                                "Content-Type": "application/http; msgtype=response",
                            },
                            http if revisit else http + payload,
                        )
                    )
                batch = next(batches, None)
        with new_file(f"{uri}/{name}.cdx") as f:
            pq.write_table(pa.table({"offset": pa.array(offsets, pa.int64()), "bytes": pa.array(sizes, pa.int64())}), f)
        cuts = [0]
        for offset, size in zip(offsets, sizes):
            if offset + size - cuts[-1] > SPLIT_BYTES and offset > cuts[-1]:
                cuts.append(offset)
        yield pa.RecordBatch.from_pydict({"file": [f"{name}.warc.gz"], "records": [len(offsets)], "bytes": [at], "cuts": [cuts]})

    return write


def write_archives(pages: DataFrame, uri: str) -> None:
    """A record for each row of pages (page_id, url, html; other columns are ignored).

    Of rows with equal payloads of at least SHORTEST_REVISIT bytes those with the smallest page_id
    are responses (all of them, if a row repeats), the others and those without a page_id revisit
    it. A null html is an empty payload. The manifest names the files that readers shall open."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    many = own.filter(F.octet_length("html") >= SHORTEST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = stored(many.filter("n > 1 and first is not null"), "digests")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    decided = join_hot(own, shared, "digest", "n", pages.count(), "left").select("page_id", "url", "html", "digest", refers)
    files = decided.mapInArrow(_writer(uri), "file string, records long, bytes long, cuts array<long>").collect()  # a row per task
    listed = sorted((r["file"], r["bytes"], r["cuts"]) for r in files)
    with new_file(f"{uri}/manifest.json") as f:
        f.write(json.dumps({"files": [{"file": n, "bytes": b, "cuts": c} for n, b, c in listed]}).encode())


class Split(InputPartition):
    """Bytes start to end of a file: records that begin there, by the index or as a stream."""

    def __init__(self, file: str, start: int, end: int | None, indexed: bool):
        self.file, self.start, self.end, self.indexed = file, start, end, indexed


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


class Damaged(ValueError):
    """What is read is no gzip member, or no headers of a record."""


class Blocks:
    """A file's bytes, inflated if need be, from where it stands on; holds about CHUNK of them."""

    def __init__(self, file, packed: bool, end: int | None = None, chunk: int = CHUNK):
        self.file, self.packed, self.end, self.chunk = file, packed, end, chunk
        self.at, self.raw, self.inflate, self.held = file.tell(), b"", None, bytearray()
        self.torn = False

    def more(self, between: bool = False) -> bool:
        """Reads on; between records a gzip member that begins at the end or later is not begun."""
        while True:
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                self.at += len(self.raw)
                if not self.raw:
                    return False
            if not self.packed:
                if between and self.end is not None and self.at - len(self.raw) >= self.end:
                    return False
                self.held += self.raw
                self.raw = b""
                return True
            if self.inflate is None:
                self.raw = self.raw.lstrip(b"\0")  # padding
                if not self.raw:
                    continue
                if between and self.end is not None and self.at - len(self.raw) >= self.end:
                    return False
                self.inflate = zlib.decompressobj(31)
            try:
                got = self.inflate.decompress(self.raw, self.chunk)
            except zlib.error as e:
                self.torn = True
                raise Damaged(f"no gzip member before byte {self.at}") from e
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            else:
                self.raw = self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True

    def recover(self) -> bool:
        """Goes on at the next member, or where none was torn at the next line, that begins a record;
        False if there is none."""
        if self.torn:
            self.torn = False
            here = self.at - len(self.raw)
            # the member's own first bytes are behind what is left to inflate, or are passed over
            start = resynced(self.file, here + (self.inflate is not None and self.raw[:3] == b"\x1f\x8b\x08"), self.end)
            self.raw, self.inflate, self.held = b"", None, bytearray()
            if start is None:
                return False
            self.file.seek(start)
            self.at = start
            return True
        while (n := self.held.find(b"\nWARC/")) < 0:
            del self.held[: max(0, len(self.held) - 5)]
            if not self.more():
                return False
        del self.held[: n + 1]
        return True

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What comes before mark, which is passed over; None if the file ends before it. An error if it
        does not come within most bytes."""
        seen = 0
        while (n := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most:
                raise Damaged(f"headers of more than {most} bytes before byte {self.at}")
            if not self.more():
                return None
        out = bytes(self.held[:n])
        del self.held[: n + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.held:
                if not self.packed and n > len(self.raw) + CHUNK:
                    self.file.seek(n - len(self.raw), 1)
                    self.at, self.raw, n = self.at + n - len(self.raw), b"", 0
                    continue
                if not self.more():
                    return
            k = min(n, len(self.held))
            del self.held[:k]
            n -= k

    def next_record(self) -> bool:
        """Passes over line ends between records; False at the end."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:n]
            if self.held:
                return True
            if not self.more(between=True):
                return False


def resynced(file, start: int, end: int | None) -> int | None:
    """Where the first gzip member from start on, before end (if given), begins that begins a record."""
    file.seek(start)
    held, at = b"", start
    while (end is None or at < end) and (got := file.read(CHUNK)):
        held += got
        k = held.find(b"\x1f\x8b\x08")
        while 0 <= k and (end is None or at + k < end):
            if len(held) < k + 4096:
                held += file.read(4096)
            try:
                if zlib.decompressobj(31).decompress(held[k : k + 4096], 5) == b"WARC/":
                    return at + k
            except zlib.error:
                pass
            k = held.find(b"\x1f\x8b\x08", k + 1)
        at, held = at + len(held) - 2, held[-2:]
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.resync = options.get("resync", "false").lower() == "true"
        self.fail = options.get("damaged", "skip").lower() == "fail"
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", RESYNC_BYTES)))
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self) -> list[Split]:
        try:
            listed = json.loads(read_bytes(f"{self.path}/manifest.json"))["files"]
        except FileNotFoundError:
            return [s for f in list_files(self.path, ".warc.gz") + list_files(self.path, ".warc") for s in self.streams(f)]
        return [Split(f"{self.path}/{x['file']}", a, e, True) for x in listed for a, e in zip(x["cuts"], [*x["cuts"][1:], x["bytes"]])]

    def streams(self, file: str) -> list[Split]:
        if not self.resync or not file.endswith(".gz"):
            return [Split(file, 0, None, False)]
        size = file_size(file)
        return [Split(file, a, min(a + self.split_bytes, size), False) for a in range(0, size, self.split_bytes)]

    def wanted(self, fields: dict) -> bool:
        for column, kind, value in self.tests:
            have = fields[column]
            if kind == "in" and have not in value or kind == "known" and have is None or kind == "starts" and not (have or "").startswith(value):
                return False
        return True

    def fields(self, head: bytes) -> dict:
        headers = parse_headers(head)
        out = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        for c in BARE:
            out[c] = out[c].strip("<>") if out[c] else None
        size = headers.get("content-length", "")
        out["content_length"] = int(size) if size.isascii() and size.isdigit() else 0
        return out

    def found(self, blocks: Blocks, one: bool = False) -> Iterator[dict]:
        """The wanted records from where blocks stand on, headers first; or of one record, if it is wanted."""
        self.cut_short = False
        while blocks.next_record():
            if (head := blocks.until(END, HEADER_BYTES)) is None:
                self.cut_short = True
                return
            fields = self.fields(head)
            left = fields["content_length"]
            if not self.wanted(fields):
                if one:
                    return
                blocks.skip(left)
                continue
            kind, out = fields["record_type"], dict(fields, http_length=None, payload=None)
            if kind in ("response", "revisit"):
                want = left if self.payload and kind == "response" else min(left, HEADER_BYTES)
                body = blocks.take(want)
                if len(body) < want:
                    self.cut_short = True
                    return
                http, _, payload = body.partition(END)
                size = parse_headers(http).get("content-length", "")
                out["http_length"] = int(size) if size.isascii() and size.isdigit() else None
                if self.payload and kind == "response":
                    out["payload"] = payload
                left -= len(body)
            elif kind in ("resource", "conversion") and self.payload:
                out["payload"] = blocks.take(left)
                if len(out["payload"]) < left:
                    self.cut_short = True
                    return
                left = 0
            yield out
            if one:
                return
            blocks.skip(left)

    def stream(self, file: str, start: int = 0, end: int | None = None) -> Iterator[dict]:
        """Records of a file without an index, compressed or not."""
        with opened(file) as f:
            if start and (start := resynced(f, start, end)) is None:
                return
            f.seek(start)
            blocks = Blocks(f, file.endswith(".gz"), end)
            while True:
                try:
                    yield from self.found(blocks)
                    return
                except Damaged as e:
                    if self.fail:
                        raise Damaged(f"{file}: {e}") from e
                    if not self.recovered(blocks):
                        return

    def recovered(self, blocks: Blocks) -> bool:
        while True:
            try:
                return blocks.recover()
            except Damaged:
                continue

    def indexed(self, split: Split) -> Iterator[dict]:
        """Records of members whose places are known: of an unwanted one only the headers are inflated."""
        index = pq.read_table(pa.BufferReader(read_bytes(split.file.removesuffix(".gz").removesuffix(".warc") + ".cdx")))
        offsets, sizes = index["offset"].to_numpy(), index["bytes"].to_numpy()
        with opened(split.file) as f:
            for k in range(*offsets.searchsorted([split.start, split.end]).tolist()):
                f.seek(int(offsets[k]))
                member = io.BytesIO(f.read(int(sizes[k])))
                try:
                    blocks = Blocks(member, True, chunk=4096)
                    yield from self.found(blocks, one=True)
                    if self.cut_short:
                        raise Damaged("a record ends before its length")
                except Damaged as e:
                    raise Damaged(f"{split.file}, byte {offsets[k]}: {e}") from e

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there are no splits
            return
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        rows, held = [], 0
        for row in self.indexed(partition) if partition.indexed else self.stream(partition.file, partition.start, partition.end):
            rows.append(row)
            held += len(row["payload"] or b"")
            if len(rows) >= 2000 or held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)


class PushingWarcReader(WarcReader):
    def pushFilters(self, filters: list[Filter]):
        """Keeps tests of the header columns; Spark applies the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = dict(self.options)
        return (PushingWarcReader if options.get("push", "false") == "true" else WarcReader)(options)


def read_archives(spark: SparkSession, uri: str, payload: bool = True, resync: bool = False) -> DataFrame:
    """SCHEMA of the records below uri. Filters are pushed down where the session allows it."""
    spark.dataSource.register(WarcSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    options = {"payload": str(payload).lower(), "resync": str(resync).lower(), "push": push}
    return spark.read.format("warc").options(**options).load(uri)


def page_records(archives: DataFrame) -> DataFrame:
    """A row per page record; size and digest of responses are those of the payload as read."""
    own = archives.filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return own.select(
        page("record_id").alias("page_id"),
        F.when(response, F.length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
