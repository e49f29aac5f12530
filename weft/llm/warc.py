"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each of whole WARC records, then a
skippable frame that maps record identifiers to places inside the frames, then the seek table
of the seekable Zstandard format, a skippable frame too. Any Zstandard reader sees the records
alone; a reader that knows the footer takes one record by decompressing one frame.

Each page becomes a record with an HTTP block. Of pages with equal payloads of at least
``LEAST`` bytes one is stored, that with the smallest id; the others are revisits that refer to
it and hold no payload. Which digests repeat is found on (id, digest) alone; payloads are never
shuffled where the repeated digests fit a broadcast of checked size, else they are joined with
them once. A task holds one frame of records and the compressed frames of one bundle.

Files are written by Spark's text writer, one bundle a row and a file, which ends each row with
the seek table's magic number as its line separator: the bytes on disk are the bundle's, on any
file system that Spark reaches, committed as Spark commits.

Defined results: a NULL html is an empty payload; a NULL url has no target; control characters
and spaces of urls are percent-encoded; a NULL id comes after all others and is read back as
NULL; of rows that share the smallest id and the payload one is stored and the others refer to
it; an empty table gives an archive without bundles; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import materialize, release, shared_dir

LEAST = 100
FRAME_BYTES = 1 << 18  # of records before compression, after which a frame is closed
BUNDLE_BYTES = 1 << 26  # of frames, after which a bundle is closed
BROADCAST_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own

# Fixed values of the Zstandard formats, and of the WARC revisit profile.
SEEK_MAGIC = b"\xb1\xea\x92\x8f"
SKIP_SEEK, SKIP_MAP = 0x184D2A5E, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PLACE = np.dtype([("id", "V16"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")])
_FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4")])
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def _urn(raw: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=raw)}>"


def record(raw_id: bytes, kind: str, page: int | None, url: str | None, digest: str, refers: bytes | None, payload: bytes) -> bytes:
    """The bytes of one WARC 1.1 record. ``payload`` stays out of a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(raw_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        head.append(f"Page-Id: {page}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Collects records of one bundle; frames are compressed as they fill."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.frames, self.sizes, self.places = frame_bytes, [], [], []
        self.held, self.filled, self.packed = [], 0, 0
        self._zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, raw_id: bytes, data: bytes) -> None:
        self.places.append((raw_id, len(self.frames), self.filled, len(data)))
        self.held.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.held:
            frame = self._zstd.compress(b"".join(self.held))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.packed += len(frame)
            self.held, self.filled = [], 0

    def close(self) -> bytes:
        """The whole bundle."""
        self._close_frame()
        places = np.array(self.places, PLACE).tobytes()
        table = np.array(self.sizes, _FRAME).tobytes()
        named = struct.pack("<II", SKIP_MAP, len(places)) + places
        own = struct.pack("<II", len(named), 0)  # the map is a frame of the seek table that holds no data
        footer = table + own + struct.pack("<IB", len(self.sizes) + 1, 0) + SEEK_MAGIC
        return b"".join(self.frames) + named + struct.pack("<II", SKIP_SEEK, len(footer)) + footer


class Bundle:
    """Reads a bundle by its footer."""

    def __init__(self, data: bytes):
        if data[-4:] != SEEK_MAGIC:
            raise ValueError("no seek table")
        self.data = data
        n = struct.unpack_from("<I", data, len(data) - 9)[0]
        sizes = np.frombuffer(data, _FRAME, n, len(data) - 9 - 8 * n)
        ends = np.cumsum(sizes["packed"].astype(np.int64))
        self.starts, self.ends, self.plain = (ends - sizes["packed"]).tolist(), ends.tolist(), sizes["plain"].tolist()
        at, end = self.starts[-1], self.ends[-1]
        if struct.unpack_from("<I", data, at)[0] != SKIP_MAP:
            raise ValueError("no record map")
        self.places = np.frombuffer(data, PLACE, (end - at - 8) // PLACE.itemsize, at + 8)

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[self.starts[i] : self.ends[i]], max_output_size=self.plain[i])

    def records(self):
        """(record id, record bytes) of all, each frame decompressed once."""
        at, held = None, b""
        for raw_id, frame, offset, length in self.places.tolist():
            if frame != at:
                at, held = frame, self.frame(frame)
            yield raw_id, held[offset : offset + length]


def _kept_id(digest: bytes) -> bytes:
    """The record id of the one stored record of a repeated payload: known wherever the digest is."""
    return hashlib.sha256(b"stored " + digest).digest()[:16]


def _classified(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (page, url, payload, digest, role): role is 0 alone, 1 stored of several, 2 a revisit; and the table behind it."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST).select("page", "digest")
    counted = long.groupBy("digest", "page").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page").isNull(), F.col("page"))
    repeated = materialize(
        counted.groupBy("digest").agg(F.min("page").alias("first"), F.min_by("n", order).alias("n_first"), F.sum("n").alias("n")).where("n > 1")
    )
    size = repeated.count() * 96  # a digest, two counts and an id
    side = F.broadcast(repeated.drop("n")) if size <= BROADCAST_BYTES else repeated.drop("n")
    here = F.col("page").eqNullSafe(F.col("first"))
    # Rows under LEAST bytes have no digest in the table.
    joined = rows.join(side, "digest", "left").withColumn("role", F.when(F.col("n_first").isNull(), 0).when(~here, 2).when(F.col("n_first") == 1, 1))
    if not repeated.where("n_first > 1").limit(1).count():
        return joined.drop("first", "n_first"), repeated
    # Rows that tie on the smallest id: written once, so that their numbers hold, one of each digest is stored.
    tied = materialize(joined.where("role IS NULL").withColumn("m", F.monotonically_increasing_id()))
    one = tied.groupBy("digest").agg(F.min("m").alias("chosen"))
    settled = tied.join(one, "digest").withColumn("role", F.when(F.col("m") == F.col("chosen"), 1).otherwise(2))
    return joined.where("role IS NOT NULL").unionByName(settled.drop("m", "chosen")).drop("first", "n_first"), repeated


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Write an archive: bundles below ``path``/bundles and their index, as Parquet, below ``path``/index."""
    rows, behind = _classified(pages, id_col, url_col, html_col)
    run_id = uuid.uuid4().bytes  # tells records of different archives apart

    def run(batches):
        from pyspark import TaskContext

        part, nth, bundle = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)
        for batch in batches:
            for page, url, payload, digest, role in zip(*batch.columns, strict=True):
                payload, digest, role = payload.as_py(), digest.as_py(), role.as_py()
                kept = _kept_id(digest.encode()) if role else None
                raw_id = kept if role == 1 else hashlib.sha256(run_id + struct.pack("<qq", part, nth)).digest()[:16]
                nth += 1
                bundle.add(raw_id, record(raw_id, "revisit" if role == 2 else "response", page.as_py(), url.as_py(), digest, kept, payload))
                if bundle.packed >= bundle_bytes:
                    yield whole(bundle)
                    bundle = BundleWriter(frame_bytes)
        if bundle.places:
            yield whole(bundle)

    def whole(bundle):  # the text writer adds the magic number, its line separator
        return pa.RecordBatch.from_arrays([pa.array([bundle.close()[:-4]], pa.binary())], ["bundle"])

    files = rows.select("page", "url", "payload", "digest", "role").mapInArrow(run, "bundle binary")
    text = files.select(F.col("bundle").cast("string").alias("value"))
    separator = SEEK_MAGIC.decode("latin-1")
    text.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", 1).text(f"{path}/bundles")
    release(behind)
    index(pages.sparkSession, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    return spark.read.format("binaryFile").load(names if names else f"{path}/bundles").select("path", "content")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (record_id, bundle, frame, offset, length), from the bundles' footers."""

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                at = Bundle(content.as_py()).places
                ids = [str(uuid.UUID(bytes=x)) for x in at["id"].tolist()]
                columns = [pa.array(ids), pa.array([name.as_py()] * len(ids)), *(pa.array(at[k].astype(np.int64)) for k in ("frame", "offset", "length"))]
                yield pa.RecordBatch.from_arrays(columns, ["record_id", "bundle", "frame", "offset", "length"])

    return _files(spark, path).mapInArrow(run, "record_id string, bundle string, frame bigint, offset bigint, length bigint")


READ = "record_id string, page_id bigint, url string, record_type string, refers_to_record string, payload_digest string, payload_bytes bigint, payload binary"


def _row(raw: bytes, with_payload: bool) -> tuple:
    fields, payload = parse(raw)
    name = lambda k: fields[k][10:-1] if k in fields else None  # noqa: E731  without <urn:uuid: and >
    stored = fields["warc-type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if stored else None
    if stored and fields["warc-payload-digest"] != f"sha256:{digest}":
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    page = int(fields["page-id"]) if "page-id" in fields else None
    size = len(payload) if stored else None
    return name("warc-record-id"), page, fields.get("warc-target-uri"), fields["warc-type"], name("warc-refers-to"), digest, size, payload if stored and with_payload else None


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in READ.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records as stored: (record_id, page_id, url, record_type, refers_to_record, payload_digest, payload_bytes, payload).

    Digest and size are those of the payload read; a revisit has none of its own (see :func:`resolve`).
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                rows, held = [], 0
                for _, raw in Bundle(content.as_py()).records():
                    rows.append(_row(raw, with_payload))
                    held += len(raw) if with_payload else 300
                    if held >= 1 << 22:
                        yield _to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _to_batch(rows)

    return _files(spark, path).mapInArrow(run, READ)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with digest, size and page id (``refers_to``) of the record they refer to, which is looked up."""
    target = records.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    )
    found = records.join(target, F.col("refers_to_record") == F.col("_id"), "left")
    return found.withColumns({"payload_digest": F.coalesce("payload_digest", "_digest"), "payload_bytes": F.coalesce("payload_bytes", "_bytes")}).drop("_id", "_digest", "_bytes")


def fetch(spark: SparkSession, path: str, record_ids: DataFrame, most_files: int = 1000) -> DataFrame:
    """The records of some identifiers, each from its frame alone. Only their bundles are opened if there are at most ``most_files``."""
    asked = spark.read.parquet(f"{path}/index").join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    wanted = materialize(asked.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places")))
    names = [r.bundle for r in wanted.select("bundle").limit(most_files + 1).collect()]
    files = _files(spark, path, names if len(names) <= most_files else None)

    def run(batches):
        for batch in batches:
            for places, content in zip(*batch.columns, strict=True):
                bundle, at, held, rows = Bundle(content.as_py()), None, b"", []
                for p in sorted(places.as_py(), key=lambda p: (p["frame"], p["offset"])):
                    if p["frame"] != at:
                        at, held = p["frame"], bundle.frame(p["frame"])
                    rows.append(_row(held[p["offset"] : p["offset"] + p["length"]], True))
                yield _to_batch(rows)

    return files.join(wanted, F.col("path") == F.col("bundle")).select("places", "content").mapInArrow(run, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write an archive into the shared folder and read it back without payloads: a row per page, revisits resolved."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/weft-warc-{uuid.uuid4().hex}"
    write(pages, path, id_col, url_col, html_col)
    return resolve(materialize(read(spark, path, with_payload=False)))
