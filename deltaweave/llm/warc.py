"""WARC archives, compressed record by record with a dictionary that the archive itself carries.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a zstandard dictionary built
from the archive's first records; each record follows as a zstandard frame of its own, made with
that dictionary, so any record can be read from its offset alone.

Of records with equal payloads, that with the largest page id is a response and the others revisit it: they have its id
and the payload's digest and length, but not the payload. Payloads shorter than `least_bytes` are always stored.

Null html is the empty payload. Rows without a page id count as smaller than all others and are written
without that field. Rows that share the largest page id are all responses. An empty table gives no archive. Payloads of any length are kept
whole. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import AtomicFile, cut, new_folder, open_input

SKIPPABLE = 0x184D2A5D
FRAME = struct.Struct("<II")
#: Bytes of an archive's first records that its dictionary is built from, and the dictionary's own size.
SAMPLE_BYTES, DICT_BYTES = 1 << 21, 1 << 16
SALTS = 16
MANIFEST = "part int, path string, n_records long, n_bytes long"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; payload None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate({0x0D: '%0D', 0x0A: '%0A'})}")
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Of the records as they are; the last of them as they stand where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class ArchiveWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.level, self.first, self.size, self.zip = out, level, [], 0, None
        self.records = self.written = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.zip is not None:
            self._put(raw)
            return
        self.first.append(raw)
        self.size += len(raw)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        shown = [r[: DICT_BYTES * 2] for r in self.first]
        words = build_dictionary(shown)
        self._write(FRAME.pack(SKIPPABLE, len(words)) + words)
        self.zip = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)
        for raw in self.first:
            self._put(raw)
        self.first = []

    def _put(self, raw: bytes) -> None:
        self._write(self.zip.compress(raw))

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.written += len(raw)

    def close(self) -> tuple[int, int]:
        if self.zip is None:
            self._begin()
        return self.records, self.written


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; one record in memory at a time."""
    magic, n = FRAME.unpack(source.read(FRAME.size))
    if magic != SKIPPABLE:
        raise ValueError("not a dictionary-compressed archive")
    words = zstandard.ZstdCompressionDict(source.read(n))
    unzip, held = zstandard.ZstdDecompressor(dict_data=words), b""
    frame, out = unzip.decompressobj(), []
    while True:
        held = held or source.read(1 << 20)
        if not held:
            if out:
                raise ValueError("the archive is cut short")
            return
        out.append(frame.decompress(held))
        held = b""
        if frame.eof:
            held = frame.unused_data
            yield parse(b"".join(out))
            frame, out = unzip.decompressobj(), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return fields, block


def refer(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Adds refers_to to (page_id, url, html, n_bytes, sha). Ids and digests alone meet to find it: the largest id of each
    digest is formed in parts first, and its salted join spreads a payload that many rows share. Texts then move once, by page id."""
    sharing = F.when(F.col("n_bytes") >= least_bytes, F.col("sha"))
    ids = rows.select("page_id", sharing.alias("sha")).where("sha is not null")
    equal = ids.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    salted = equal.select("sha", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    pairs = own.join(salted, ["sha", "salt"]).where("page_id is null or page_id < first_id").select("page_id", "sha", F.col("first_id").alias("refers_to")).distinct()
    r, p = rows.withColumn("sharing", sharing).alias("r"), pairs.alias("p")
    joined = r.join(p, F.col("r.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("r.sharing") == F.col("p.sha")), "left")
    return joined.select("r.page_id", "url", F.when(F.col("refers_to").isNull(), F.coalesce("html", F.lit(""))).alias("payload"), "n_bytes", F.col("r.sha").alias("sha"), "refers_to")


def write_archives(df: DataFrame, least_bytes: int = 0, level: int = 3, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row to an archive of the shared folder; returns the manifest, cut to that folder too."""
    folder = new_folder(df.sparkSession, "warc")
    html = F.coalesce(df[payload_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].alias("url"), df[payload_col].alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))

    def run(batches):
        part, writer, out, scope = TaskContext.get().partitionId(), None, None, None
        name = f"{folder}/part-{part:06d}.warc.zst"
        try:
            for batch in batches:
                if writer is None and batch.num_rows:
                    scope = AtomicFile(name)
                    writer = ArchiveWriter(scope.__enter__(), level)
                for k in range(batch.num_rows):
                    page_id, url, payload, n_bytes, sha, refers_to = (batch.column(c)[k].as_py() for c in range(6))
                    writer.add(record(page_id, url, None if payload is None else payload.encode(), n_bytes, base64.b32encode(sha).decode(), refers_to))
            if writer is None:
                return
            made = writer.close()
        except BaseException as e:
            if scope is not None:
                scope.__exit__(type(e), e, None)
            raise
        scope.__exit__(None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in made)], ["part", "path", "n_records", "n_bytes"])

    return cut(refer(rows, least_bytes).mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: page id, length and digest of the full payload, type, and what it refers to.

    Lengths and digests of stored payloads are taken from the payloads, and have to be those that the record states."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_input(name) as source:
                    rows = []
                    for fields, block in read_archive(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n = int(head.rpartition(b"Content-Length: ")[2])
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != n or digest(payload) != stated):
                            raise ValueError(f"a payload of {name} isn't what its record states")
                        number = lambda f: int(x.rpartition(":")[2][:-1]) if (x := fields.get(f)) else None  # noqa: B023, E731
                        rows.append((number("WARC-Record-ID"), n, stated, fields["WARC-Type"], number("WARC-Refers-To")))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").select("path").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split(" ")[0] for c in SCHEMA.split(", ")])
