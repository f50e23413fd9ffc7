"""Token ids in files of bit or byte planes, with a chunk index.

A file (all integers little-endian):

    magic    8 bytes  b"SLUBPF01"
    chunks   one after another; each holds the compressed planes of one block of ids, in order
    docs     zstandard frame: null flags (1 byte each), doc ids (int64), lengths (uint32), per document
    index    zstandard frame: per chunk offset (uint64), ids (uint32), planes (uint32), crc32 of the
             ids (uint32), then the compressed length of each of its planes (uint32)
    footer   48 bytes: offsets and lengths of docs and index (4 x uint64), documents (uint64), magic

A block is a fixed number of ids, so a document may span blocks. Plane k of a block is the k-th byte
(or bit) of all its ids; planes above the highest one in use are not stored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyarrow import fs

MAGIC = b"SLUBPF01"
_FOOTER = struct.Struct("<QQQQQ8s")


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = raw.T
    elif unit == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        raise ValueError("unit is byte or bit")
    used = max((k + 1 for k, p in enumerate(planes) if p.any()), default=0)
    return [p.tobytes() for p in planes[:used]]


def from_planes(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    """The ids again; the reverse of to_planes."""
    if unit == "byte":
        raw = np.zeros((4, n), dtype=np.uint8)
        for k, p in enumerate(planes):
            raw[k] = np.frombuffer(p, dtype=np.uint8)
        return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)
    bits = np.zeros((32, n), dtype=np.uint8)
    for k, p in enumerate(planes):
        bits[k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little")[:n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one file to ``out``; holds one block and the document index, whatever the file's size."""

    def __init__(self, out, block: int = 1 << 16, unit: str = "byte", level: int = 3):
        if block < 1:
            raise ValueError("a block holds at least one id")
        self.out, self.block, self.unit = out, block, unit
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.chunks: list[bytes] = []
        self.doc_ids: list[int] = []
        self.nulls, self.lengths = bytearray(), []
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.nulls.append(doc_id is None)
        self.doc_ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(np.asarray(ids, dtype="<u4"))
        self.n_held += len(ids)
        if self.n_held >= self.block:
            have = np.concatenate(self.held)
            whole = len(have) // self.block * self.block
            for k in range(0, whole, self.block):
                self._chunk(have[k : k + self.block])
            self.held, self.n_held = [have[whole:]], len(have) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.unit)]
        self.chunks.append(struct.pack("<QIII", self.at, len(ids), len(planes), zlib.crc32(ids.tobytes())) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        docs = self.zstd.compress(bytes(self.nulls) + np.array(self.doc_ids, dtype="<i8").tobytes() + np.array(self.lengths, dtype="<u4").tobytes())
        index = self.zstd.compress(self.unit.encode().ljust(4) + b"".join(self.chunks))
        self.out.write(docs)
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.at, len(docs), self.at + len(docs), len(index), len(self.lengths), MAGIC))


class Reader:
    """Reads a file by its index: single chunks, or all documents with one chunk in memory."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        size = file.tell()
        if size < len(MAGIC) + _FOOTER.size:
            raise ValueError("not a plane file: too short")
        at, n, index_at, index_n, self.n_docs, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file: wrong magic")
        unzip = zstandard.ZstdDecompressor()
        docs, index, d = unzip.decompress(self._read(at, n)), unzip.decompress(self._read(index_at, index_n)), self.n_docs
        self.nulls = np.frombuffer(docs, dtype=np.uint8, count=d)
        self.doc_ids = np.frombuffer(docs, dtype="<i8", count=d, offset=d)
        self.lengths = np.frombuffer(docs, dtype="<u4", count=d, offset=9 * d)
        self.unit, at = index[:4].decode().strip(), 4
        self.chunks: list[tuple[int, int, int, tuple[int, ...]]] = []
        while at < len(index):
            offset, ids, planes, crc = struct.unpack_from("<QIII", index, at)
            self.chunks.append((offset, ids, crc, struct.unpack_from(f"<{planes}I", index, at + 20)))
            at += 20 + 4 * planes

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, lengths = self.chunks[k]
        unzip, planes = zstandard.ZstdDecompressor(), []
        for length in lengths:
            planes.append(unzip.decompress(self._read(at, length)))
            at += length
        ids = from_planes(planes, n, self.unit)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of all documents, in file order."""
        k, have = 0, np.zeros(0, dtype="<u4")
        for null, doc_id, n in zip(self.nulls, self.doc_ids, self.lengths, strict=True):
            parts, missing = [have], int(n) - len(have)
            while missing > 0:
                parts.append(self.chunk(k))
                missing -= len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield (None if null else int(doc_id)), have[:n]
            have = have[n:]


def write_file(uri: str, docs: Iterable[tuple[int | None, np.ndarray]], **how) -> tuple[int, int]:
    """Write (doc_id, ids) pairs; returns numbers of documents and ids.

    The file appears under its name when it is whole: a task that dies half way leaves none, and a
    task that runs twice puts the same file there twice.
    """
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        w = Writer(out, **how)
        for doc_id, ids in docs:
            w.add(doc_id, ids)
        w.close()
    store.move(part, path)
    return len(w.lengths), w.n_ids


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of all documents of a file."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        yield from Reader(file).documents()
