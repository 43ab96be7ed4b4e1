"""Token ids in binary files: bit-plane shuffling, one zstandard frame per plane, and a chunk index.

A file holds ids of whole documents in ascending document order, in chunks of a fixed number
of ids. A chunk is transposed: plane k holds the k-th byte (or bit) of each of its ids, and each
plane is a zstandard frame of its own, so the high planes, which hardly vary, shrink to a few bytes.

    "DWTOK001"  planes of chunk 0, planes of chunk 1, ...  documents  index  tail
    index      JSON, a zstandard frame: {"planes", "chunk", "offsets", "counts", "sizes", "documents"}
    documents  zstandard frame of all document ids (int64), then all lengths (int64), little-endian
    tail       offset and size of the index, two little-endian uint64, then "DWTOK001"

Any chunk can be read alone by the index. Null text is the empty text and has the end id alone;
rows of equal document id stand next to each other in order of their text; null ids come first.
An empty table makes no file, and its reading no row. Other columns of the input aren't read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import TextEncoder
from .shared import AtomicFile, cut, new_folder, open_input
from .words import BLOCK, blocks

MAGIC = b"DWTOK001"
TAIL = struct.Struct("<QQ8s")
CHUNK = 1 << 16
NO_ID = -(1 << 63)
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    parts = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "byte":
        return np.stack(parts, axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class TokenWriter:
    """Writes one file to an open stream; holds a chunk of ids, and id and length of each document."""

    def __init__(self, out, planes: str = "byte", chunk: int = CHUNK, level: int = 3):
        self.out, self.kind, self.chunk, self.zip = out, planes, chunk, zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting, self.at = [], 0, len(MAGIC)
        self.offsets, self.counts, self.sizes, self.docs, self.lengths = [], [], [], [], []
        out.write(MAGIC)

    def add(self, docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(docs, "<i8"))
        self.lengths.append(np.asarray(lengths, "<i8"))
        self.waiting.append(np.asarray(ids, "<u4"))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.chunk * self.chunk
            for k in range(0, full, self.chunk):
                self._put(flat[k : k + self.chunk])
            self.waiting, self.n_waiting = [flat[full:]], len(flat) - full

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.offsets.append(self.at)
        self.counts.append(len(ids))
        self.sizes.append([len(p) for p in packed])
        self.out.write(b"".join(packed))
        self.at += sum(self.sizes[-1])

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the whole file."""
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        docs = self.zip.compress(b"".join(x.tobytes() for x in (*self.docs, *self.lengths)))
        index = self.zip.compress(json.dumps({"planes": self.kind, "chunk": self.chunk, "offsets": self.offsets, "counts": self.counts, "sizes": self.sizes, "documents": [self.at, len(docs)]}).encode())
        self.out.write(docs + index + TAIL.pack(self.at + len(docs), len(index), MAGIC))
        return sum(map(len, self.docs)), sum(self.counts), self.at + len(docs) + len(index) + TAIL.size


class TokenReader:
    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        at, n, magic = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.index = json.loads(self._unpack(at, n))
        both = np.frombuffer(self._unpack(*self.index["documents"]), "<i8")
        self.docs, self.lengths = both[: len(both) // 2], both[len(both) // 2 :]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _unpack(self, at: int, n: int) -> bytes:
        return self.unzip.decompressobj().decompress(self._read(at, n))

    def chunk(self, k: int) -> np.ndarray:
        sizes = self.index["sizes"][k]
        raw = self._read(self.index["offsets"][k], sum(sizes))
        ends = np.cumsum(sizes)
        return from_planes([self.unzip.decompressobj().decompress(raw[e - n : e]) for e, n in zip(ends, sizes, strict=True)], self.index["counts"][k], self.index["planes"])

    def checksums(self):
        """crc32 of each document's ids, whatever chunks they lie in."""
        k, here = -1, np.empty(0, "<u4")
        for n in self.lengths.tolist():
            crc = 0
            while n:
                if not len(here):
                    k += 1
                    here = self.chunk(k)
                part, here = here[:n], here[n:]
                crc, n = zlib.crc32(part.tobytes(), crc), n - len(part)
            yield crc


#: Bytes that white space other than a piece's first space has or may have.
ODD = np.zeros(256, bool)
ODD[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class LibraryPieces:
    """The tokenizers library on pieces, many in one text: a piece with a space before it is cut off by that, and others get a
    line feed before them, which is a piece of its own there. Lengths of tokens tell where each piece's tokens end; where
    they don't, and where a piece may have other white space, it is encoded alone."""

    def __init__(self, tokenizer, together: int = 4096):
        self.tokenizer, self.together = tokenizer, together
        vocabulary = tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        spaced = (data[starts] == 0x20) & (size > 1)
        odd = np.concatenate([[0], np.cumsum(ODD[data])])
        joint = np.flatnonzero(odd[ends] - odd[starts] == spaced)
        start, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        flat = np.empty(0, np.int32)
        if len(joint):
            n = size[joint]
            last = np.cumsum(n + ~spaced[joint])
            first = last - n
            text = np.full(int(last[-1]), 0x0A, np.uint8)
            source = np.arange(int(n.sum())) + np.repeat(starts[joint] - (np.cumsum(n) - n), n)
            text[np.arange(len(source)) + np.repeat(first - (np.cumsum(n) - n), n)] = data[source]
            cuts = [0, *last[self.together - 1 :: self.together].tolist()]
            cuts += [len(text)] * (cuts[-1] < len(text))
            flat = np.concatenate(self._encode([text[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
            edges = np.concatenate([[0], np.cumsum(self.length[flat])])
            a, b = np.searchsorted(edges, first), np.searchsorted(edges, last)
            sound = (edges[np.minimum(a, len(flat))] == first) & (edges[np.minimum(b, len(flat))] == last) & (edges[-1] == len(text))
            start[joint], count[joint] = a, np.where(sound, b - a, 0)
        alone = np.flatnonzero(count == 0)
        if len(alone):
            raw = data.tobytes()
            found = self._encode([raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
            count[alone] = [len(f) for f in found]
            start[alone] = len(flat) + np.cumsum(count[alone]) - count[alone]
            flat = np.concatenate([flat, *found])
        return flat, start, count


@lru_cache(maxsize=2)
def library_encoder(path: str, pattern: str) -> TextEncoder:
    """The tokenizers library behind the store of pieces: it encodes each distinct piece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    return TextEncoder(LibraryPieces(t), special, pattern)


def write_token_files(df: DataFrame, path: str, pattern: str, end_id: int = 0, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; returns the manifest (one row per file), itself cut to the shared folder.

    The one shuffle ranges texts by document id, so each file holds a range of ids, ascending.
    """
    folder = new_folder(df.sparkSession, "tokens")

    def run(batches):
        part = TaskContext.get().partitionId()
        name, encoder = f"{folder}/part-{part:06d}.tok", library_encoder(path, pattern)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with AtomicFile(name) as out:
            writer = TokenWriter(out, planes)
            for batch in (b for bs in ([first], batches) for b in bs):
                docs = batch.column(0).fill_null(NO_ID).to_numpy()
                for i, j in blocks(batch.column(1), 2 * BLOCK):
                    ids, at = encoder.rows(batch.column(1).slice(i, j - i))
                    writer.add(docs[i:j], np.diff(at) + 1, np.insert(ids, at[1:], end_id))
            made = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in made)], ["part", "path", "n_docs", "n_tokens", "n_bytes"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return cut(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: its place among all ids, its number of ids and their checksum, from the files alone."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(name) as source:
                    reader = TokenReader(source)
                    ends = np.cumsum(reader.lengths) + start
                    docs = pa.array(reader.docs, mask=reader.docs == NO_ID)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(ends - reader.lengths), pa.array(reader.lengths), pa.array(list(reader.checksums()), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    placed = manifest.select("path", "part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("start"))
    return placed.repartitionByRange(files, "part").select("path", "start").mapInArrow(run, SCHEMA)
