"""The XML product feed as a batch data source: one row per record.

Ranges of bytes are looked through in parallel for where records start, whatever stands in comments, CDATA and instructions that go on from one
range to the next; then records are parsed in parallel. A record that is not well-formed neither hides nor swallows the next one. Broken feeds are
refused before any row is made.

    load(spark, path)

The source can be read by itself too; then the driver looks through the feed:

    spark.dataSource.register(FeedSource)
    spark.read.format("feed_xml").option("path", ...).option("startByte", 0).option("startRecord", 0).load()
    spark.readStream.format("feed_xml").option("path", ...).option("maxBytes", 1 << 30).option("position", ...).load()
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import RAW_RECORD

# Limits of the feed in bytes and items, and its element names.
CHUNK, HEAD, TAIL, ID_HEAD = 64 * 1024, 64 * 1024, 128 * 1024, 8 * 1024
MAX_RECORD, MAX_FIELD, MAX_ATTRIBUTE, MAX_URL = 4 * 1024 * 1024, 2 * 1024 * 1024, 191, 16 * 1024
MAX_IMAGES, MAX_OPTIONS = 1000, 5000
SCALARS = ("name", "creation_date", "brand", "category_path", "color", "type", "price", "description")
OPTION_FIELDS = {"option_name": "name", "STOCK": "stock", "avaible_in": "available_in", "ean": "ean"}
PARTITION_BYTES = 16 * 1024 * 1024

TOKEN = re.compile(rb"<!\[CDATA\[|<!--|<\?|<product(?=[\s>/])|</product\s*>")
CLOSERS = {b"<![CDATA[": b"]]>", b"<!--": b"-->", b"<?": b"?>"}


class FeedError(ValueError):
    """The feed as a whole can't be used."""


def _local(path: str) -> str | None:
    """The plain path of a local one, by path or file: URI; null for any other place."""
    url = urlparse(path)
    return path if url.scheme == "" else unquote(url.path) if url.scheme == "file" else None


def _place(path: str):
    """(file system, path in it) of a path or of any URI that Arrow's file systems know."""
    from pyarrow import fs

    plain = _local(path)
    return (fs.LocalFileSystem(), os.path.abspath(plain)) if plain is not None else fs.FileSystem.from_uri(path)


class Pieces:
    """A frozen copy as one seekable input: files of `size` bytes, named by where they begin; the last may be shorter."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        with open_file(f"{self.folder}/{PIECES}") as f:
            found = json.loads(f.read())
        self.length, self.size, self.at = found["length"], found["size"], 0
        self.number, self.piece = None, None

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.at = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.at, os.SEEK_END: self.length}[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        end, out = self.length if n < 0 else min(self.length, self.at + n), []
        while self.at < end:
            k = self.at // self.size
            if k != self.number:
                self.close()
                self.number, self.piece = k, open_file(f"{self.folder}/{piece_name(k * self.size)}")
            self.piece.seek(self.at - k * self.size)
            some = self.piece.read(min(end, (k + 1) * self.size) - self.at)
            if not some:
                raise OSError(f"{self.folder} lacks bytes from {self.at} on")
            out.append(some)
            self.at += len(some)
        return b"".join(out)

    def close(self) -> None:
        if self.piece is not None:
            self.piece.close()
        self.number, self.piece = None, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


#: Names of the files of a frozen copy: the list, which is there once all others are, and each piece.
PIECES = "pieces.json"


def piece_name(start: int) -> str:
    return f"piece-{start:016d}"


def is_frozen(path: str) -> bool:
    """The path is a folder that freeze_parallel() has made whole."""
    store, inner = _place(path)
    return _exists(store, f"{inner.rstrip('/')}/{PIECES}")


def open_file(path: str):
    """A seekable input by path or URI; a frozen copy as the one file that it is a copy of."""
    store, inner = _place(path)
    if store.get_file_info(inner).type.name == "Directory":
        return Pieces(path)
    plain = _local(path)
    if plain is not None:
        return open(plain, "rb")
    return store.open_input_file(inner)


def check_root(head: bytes) -> None:
    text = re.sub(rb"<!--.*?-->|<\?xml.*?\?>", b"", head.removeprefix(b"\xef\xbb\xbf"), flags=re.S).lstrip()
    if re.search(rb"<!DOCTYPE", text.split(b"<product", 1)[0], re.I):
        raise FeedError("a feed may not have a DOCTYPE")
    if not re.match(rb"<products[\s>]", text):
        raise FeedError("the root element isn't <products>")


def check_tail(tail: bytes) -> None:
    if not re.search(rb"</products\s*>\s*(<!--.*?-->\s*)*$", tail, re.S):
        raise FeedError("the feed ends before </products>")


def spans(source, start: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of each record from a byte on: comments, CDATA and instructions are passed over, a closing tag ends a record at any
    depth, and so does the next opening one."""
    source.seek(start)
    held, base, begin, at, until = b"", start, None, 0, None
    while True:
        more = source.read(CHUNK)
        held += more
        last = not more
        while True:
            if until is not None:
                end = held.find(until, at)
                if end < 0:
                    at = max(at, len(held) - len(until) + 1)
                    break
                at, until = end + len(until), None
            m = TOKEN.search(held, at)
            if m is None or (m.end() == len(held) and not last):
                at = m.start() if m is not None else max(at, len(held) - 16)
                break
            token = m.group()
            if token in CLOSERS:
                at, until = m.end(), CLOSERS[token]
                continue
            if token.startswith(b"</"):
                if begin is not None:
                    yield begin, base + m.end()
                    begin = None
            else:
                if begin is not None:
                    yield begin, base + m.start()
                begin = base + m.start()
                close = held.find(b">", m.end())
                if close > 0 and held[close - 1 : close] == b"/":
                    yield begin, base + close + 1
                    begin = None
            at = m.end()
        if last:
            if begin is not None:
                yield begin, base + len(held)
            return
        held, base, at = held[at:], base + at, 0
        if begin is not None and base + len(held) - begin > 2 * MAX_RECORD:
            raise FeedError(f"the record at byte {begin} exceeds {MAX_RECORD} bytes")


def recover_id(fragment: bytes) -> str | None:
    m = re.match(rb"<product\b[^>]*?\sid\s*=\s*[\"'](\d+)[\"']", fragment[:ID_HEAD])
    return m and m[1].decode()


def _text(node: ET.Element, record: int) -> str:
    if len(node):
        raise FeedError(f"record {record}: <{node.tag}> holds elements")
    value = node.text or ""
    if len(value.encode()) > MAX_FIELD:
        raise FeedError(f"record {record}: <{node.tag}> exceeds {MAX_FIELD} bytes")
    return value.strip(" \t\n\r\0\x0b")


def _attribute(node: ET.Element, name: str, record: int) -> str:
    value = (node.get(name) or "").strip()
    if len(value.encode()) > MAX_ATTRIBUTE:
        raise FeedError(f"record {record}: {node.tag}/@{name} exceeds {MAX_ATTRIBUTE} bytes")
    return value


def parse(fragment: bytes, record: int, end: int) -> tuple:
    """One raw record; an unreadable one whose id can be told is marked to be skipped."""
    if len(fragment) > MAX_RECORD:
        raise FeedError(f"record {record} exceeds {MAX_RECORD} bytes")
    try:
        root = ET.fromstring(fragment)
    except ET.ParseError as e:
        key = recover_id(fragment)
        if key is None:
            raise FeedError(f"record {record} can't be read and has no id") from e
        return (record, end, key, *(None,) * 4, None, None, None, [], None, None, [], [], True, f"unreadable: {e}")
    values: dict = {}
    images: list[str] = []
    options: list[tuple] = []
    warnings: list[str] = []
    seen: set[str] = set()
    for node in root:
        if node.tag in seen and node.tag in (*SCALARS, "category", "images", "options"):
            raise FeedError(f"record {record}: <{node.tag}> stands twice")
        seen.add(node.tag)
        if node.tag in SCALARS:
            values[node.tag] = _text(node, record)
        elif node.tag == "category":
            values["category"] = (_attribute(node, "id", record), _text(node, record))
        elif node.tag == "images":
            raw = dict.fromkeys((_text(i, record), i.text or "")[1] for i in node if i.tag == "image_url")
            if sum(i.tag == "image_url" for i in node) > MAX_IMAGES:
                raise FeedError(f"record {record} has more than {MAX_IMAGES} images")
            for k, url in enumerate(raw):
                if len(url.encode()) > MAX_URL:
                    warnings.append(f"image {k + 1} exceeds {MAX_URL} bytes")
                elif url.strip():
                    images.append(url.strip())
        elif node.tag == "options":
            found = [o for o in node if o.tag == "option"]
            if len(found) > MAX_OPTIONS:
                raise FeedError(f"record {record} has more than {MAX_OPTIONS} options")
            for o in found:
                tags = [c.tag for c in o]
                if len(tags) != len(set(tags)):
                    raise FeedError(f"record {record}: an option has a field twice")
                got = {OPTION_FIELDS[c.tag]: _text(c, record) for c in o if c.tag in OPTION_FIELDS}
                options.append((_attribute(o, "id", record), *(got.get(f, "") for f in ("name", "stock", "available_in", "ean"))))
    v = values.get
    return (record, end, _attribute(root, "id", record), v("name", ""), v("creation_date", ""), v("brand", ""), v("category_path", ""), v("category"), v("color", ""), v("type", ""), images, v("price", ""), v("description", ""), options, warnings, False, None)


@dataclass
class Range(InputPartition):
    start: int
    end: int
    record: int


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.start, self.record = int(options.get("startByte", 0)), int(options.get("startRecord", 0))
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None

    def partitions(self):
        if self.ranges is not None:
            return [Range(*r) for r in self.ranges] or [Range(0, 0, 0)]
        with open_file(self.path) as f:
            check_root(f.read(HEAD))
            end = f.seek(0, os.SEEK_END)
            f.seek(max(0, end - TAIL))
            check_tail(f.read())
            parts: list[Range] = []
            for k, (a, b) in enumerate(spans(f, self.start)):
                if parts and b - parts[-1].start <= self.size:
                    parts[-1].end = b
                else:
                    parts.append(Range(a, b, self.record + k))
        return parts or [Range(0, 0, 0)]

    def read(self, partition: Range):
        return read_range(self.path, partition)


def read_range(path: str, part: Range) -> Iterator[tuple]:
    """The records that begin in a range."""
    if part.end == part.start:
        return
    with open_file(path) as f:
        for k, (a, b) in enumerate(spans(f, part.start)):
            if a >= part.end:
                return
            f2 = f.tell()
            f.seek(a)
            fragment = f.read(b - a)
            f.seek(f2)
            yield parse(fragment, part.record + k + 1, b)


CLOSED = re.compile(rb"(</product\s*|/)>$")


class FeedStream(DataSourceStreamReader):
    """A feed in micro-batches: offsets are the byte and the record that have been reached, and never lie within a record. A feed may grow; what it has of
    a record that isn't closed waits. Each batch takes up to `maxBytes`, if given.

    Spark names no offset when it asks for the latest one, so after a restart the first batch would take all that is there. Where `position` names a
    file, each batch leaves its end there once it is done, and a query that goes on begins with a batch of the usual size.
    """

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.most, self.position = int(options.get("maxBytes", 0)), options.get("position")
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"byte": 0, "record": 0}

    def _known(self) -> dict:
        if self.position is not None:
            try:
                with open_file(self.position) as f:
                    return json.loads(f.read())
            except OSError:
                pass
        return self.initialOffset()

    def latestOffset(self) -> dict:
        at = self.at or self._known()
        bounded = self.most > 0 and (self.at is not None or self.position is not None)
        byte, n = at["byte"], 0
        with open_file(self.path) as f:
            if at["byte"] == 0:
                check_root(f.read(HEAD))
            last = None
            for a, b in spans(f, at["byte"]):
                if last is not None:
                    byte, n = last[1], n + 1
                    if bounded and byte - at["byte"] >= self.most:
                        break
                last = (a, b)
            else:
                if last is not None:
                    f.seek(max(last[0], last[1] - 64))
                    if CLOSED.search(f.read(last[1] - f.tell())):
                        byte, n = last[1], n + 1
        self.at = {"byte": byte, "record": at["record"] + n}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        parts: list[Range] = []
        if start["byte"] < end["byte"]:
            with open_file(self.path) as f:
                for k, (a, b) in enumerate(spans(f, start["byte"])):
                    if a >= end["byte"]:
                        break
                    if parts and b - parts[-1].start <= self.size:
                        parts[-1].end = b
                    else:
                        parts.append(Range(a, b, start["record"] + k))
        return parts

    def read(self, partition: Range):
        return read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        if self.position is not None:
            store, inner = _place(self.position)
            _put(store, inner, lambda out: out.write(json.dumps(end).encode()))


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "feed_xml"

    def schema(self):
        return RAW_RECORD

    def reader(self, schema):
        return FeedReader(self.options)

    def streamReader(self, schema):
        return FeedStream(self.options)


# The parallel look through a feed.

#: Text in which a range may end: no token of the feed's grammar is within twelve bytes of it, nor is it in the white space of a closing tag.
_QUIET = rb"[^<>\]\-?!]"
SEAM = re.compile(_QUIET + rb"{12}\s(?!\s)" + _QUIET + rb"{13}")
STATES = (None, *CLOSERS.values())


def _seam(f, at: int, end: int) -> int:
    """The first place from `at` on where a range may end."""
    held, base = b"", at
    f.seek(at)
    while base < end:
        held += f.read(CHUNK)
        m = SEAM.search(held)
        if m:
            return base + m.start() + 14
        if base + len(held) >= end:
            return end
        base, held = base + len(held) - 64, held[-64:]
    return end


def _through(data: bytes, length: int, closer: bytes | None) -> tuple[bytes | None, int, int]:
    """What is still open after `length` bytes of data, how many records start in them, and where the first look for a record begins."""
    at, n, first = 0, 0, 0
    if closer is not None:
        end = data.find(closer, 0, length)
        if end < 0:
            return closer, 0, length
        at = first = end + len(closer)
    while (m := TOKEN.search(data, at)) is not None and m.start() < length:
        at = m.end()
        if (until := CLOSERS.get(m.group())) is not None:
            end = data.find(until, at, length)
            if end < 0:
                return until, n, first
            at = end + len(until)
        elif not m.group().startswith(b"</"):
            n += 1
    return None, n, first


def plan(spark, path: str, start: int = 0, record: int = 0, size: int = PARTITION_BYTES) -> list[tuple[int, int, int]]:
    """(start, end, records before) of ranges of about `size` bytes. Each task says of its range, for each construct that may be open where it starts, what
    is open where it ends and how many records it has; the driver joins these up, four rows a range."""
    import pyarrow as pa

    with open_file(path) as f:
        check_root(f.read(HEAD))
        end = f.seek(0, os.SEEK_END)
        f.seek(max(0, end - TAIL))
        check_tail(f.read())
    n = max(1, -(-(end - start) // size))

    def run(batches):
        for batch in batches:
            with open_file(path) as f:
                for k in batch.column(0).to_pylist():
                    a = start if k == 0 else _seam(f, start + k * size, end)
                    b = end if k == n - 1 else _seam(f, start + (k + 1) * size, end)
                    f.seek(a)
                    data = f.read(max(0, b - a) + 64)
                    rows = [_through(data, max(0, b - a), s) for s in STATES]
                    yield pa.RecordBatch.from_pylist([{"k": k, "a": a, "b": b, "before": i, "after": STATES.index(s), "n": c, "first": a + at} for i, (s, c, at) in enumerate(rows)], schema)

    schema = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("n", pa.int64()), ("first", pa.int64())])
    found = spark.range(0, n, 1, min(n, 10_000)).mapInArrow(run, "k long, a long, b long, before int, after int, n long, first long").collect()
    by = {(r["k"], r["before"]): r for r in found}
    out, state = [], 0
    for k in range(n):
        r = by[k, state]
        if r["n"]:
            out.append((r["first"], r["b"], record))
        record, state = record + r["n"], r["after"]
    return out


def load_ranges(spark, path: str, ranges: list[tuple[int, int, int]]):
    """Raw records of some of a feed's ranges, as plan() gives them."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("feed_xml").option("path", path).option("ranges", json.dumps(ranges)).load()


def load(spark, path: str, start: int = 0, record: int = 0, size: int = PARTITION_BYTES):
    """Raw records of a feed, from a byte and record on."""
    return load_ranges(spark, path, plan(spark, path, start, record, size))


# Fingerprints, and inputs that don't change while a run reads them.


def fingerprint(path: str) -> str:
    """Of a file: place, size, times, identity where it is local, and both of its ends. Of a frozen copy: that of what it is a copy of."""
    if is_frozen(path):
        with open_file(f"{path.rstrip('/')}/{PIECES}") as f:
            return json.loads(f.read())["fingerprint"]
    plain = _local(path)
    if plain is not None:
        s = os.stat(plain)
        size, parts = s.st_size, [os.path.realpath(plain), s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_dev, s.st_ino]
    else:
        store, inner = _place(path)
        info = store.get_file_info(inner)
        if not info.is_file:
            raise FileNotFoundError(path)
        size, parts = info.size, [path, info.size, info.mtime_ns]
    with open_file(path) as f:
        head = f.read(HEAD)
        f.seek(max(0, size - HEAD))
        tail = f.read(HEAD)
    return hashlib.sha256("\n".join(map(str, parts)).encode() + head + tail).hexdigest()


def fingerprint_remote(url: str, content: bytes) -> str:
    return hashlib.sha256((url + hashlib.sha256(content).hexdigest()).encode()).hexdigest()


def _exists(store, path: str) -> bool:
    return store.get_file_info(path).is_file


def _put(store, path: str, write) -> None:
    """A file that gets its name only when it is whole."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path + ".tmp") as out:
        write(out)
    store.move(path + ".tmp", path)


def freeze(path: str, run_dir: str) -> str:
    """A copy of the input for one run, made whole before it gets its name; its path in the run's folder, which may be anywhere."""
    store, top = _place(run_dir)
    if not _exists(store, f"{top}/source.xml"):

        def copy(out) -> None:
            with open_file(path) as f:
                while chunk := f.read(16 * CHUNK):
                    out.write(chunk)

        _put(store, f"{top}/source.xml", copy)
    return f"{run_dir.rstrip('/')}/source.xml"


def freeze_parallel(spark, path: str, folder: str, size: int = PARTITION_BYTES) -> str:
    """A copy of the input for one run, made by tasks piece by piece; its folder. Nothing passes through the driver. The list of pieces comes last, and only
    if the feed is then what it was at first; a copy that has one is never made again, so it stays as it is whatever becomes of the feed.

    folder: by path, or by any URI that Arrow's file systems know; tasks write there too. A piece that a task writes again is the same.
    """
    if is_frozen(folder):
        return folder
    before = fingerprint(path)
    with open_file(path) as f:
        length = f.seek(0, os.SEEK_END)

    def copy(batches):
        store, top = _place(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with open_file(path) as f:
                    f.seek(k * size)
                    left, name = min(size, length - k * size), f"{top}/{piece_name(k * size)}"
                    store.create_dir(top, recursive=True)
                    own = f"{name}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(own) as out:
                        while left and (chunk := f.read(min(left, 16 * CHUNK))):
                            out.write(chunk)
                            left -= len(chunk)
                    store.move(own, name)
            yield batch

    n = -(-length // size)
    if n:
        spark.range(0, n, 1, min(n, 10_000)).mapInArrow(copy, "id long").write.format("noop").mode("overwrite").save()
    if fingerprint(path) != before:
        raise FeedError("the feed has changed while it was copied")
    store, top = _place(folder)
    _put(store, f"{top}/{PIECES}", lambda out: out.write(json.dumps({"length": length, "size": size, "fingerprint": before}).encode()))
    return folder


def save_checkpoint(run_dir: str, record: int, byte: int) -> None:
    store, top = _place(run_dir)
    _put(store, f"{top}/checkpoint.json", lambda out: out.write(json.dumps({"record": record, "byte": byte}).encode()))


def load_checkpoint(run_dir: str, record: int) -> tuple[int, int]:
    """(record, byte) to go on from: the sidecar's if it is at the record that the run's state knows, else the start."""
    store, top = _place(run_dir)
    try:
        with store.open_input_file(f"{top}/checkpoint.json") as f:
            c = json.loads(f.read())
    except (OSError, ValueError):
        return 0, 0
    return (c["record"], c["byte"]) if c.get("record") == record else (0, 0)


def release(run_dir: str) -> None:
    store, top = _place(run_dir)
    if store.get_file_info(top).type.name == "Directory":
        store.delete_dir(top)
