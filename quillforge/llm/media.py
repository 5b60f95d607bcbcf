"""Media columns: payloads in image archives, read through a custom Spark data source.

``write_archives`` stores each payload as an 8-bit greyscale PNG (64 samples a row) in ZIP archives that roll at
``archive_bytes``. Tasks write archives under names of their own and report them; only reported archives are listed in the
manifest, so an attempt that was lost leaves nothing that is read.

``ArchiveSource`` (format ``media_archive``) plans on the driver: each archive of the manifest is cut into byte ranges, and
ranges are packed into partitions; more bytes make larger partitions once there are ``maxpartitions``. A task reads an
archive's directory, takes the members whose headers begin in its range, fetches each by its own offset, and tries a member
again by itself if reading or checking it fails; opening an archive and reading its directory are tried again too. Payload
batches stream to Spark through Arrow.

Null and empty payloads become 64 zero bytes. Equal payloads have equal media bytes. Keys may be null or repeat and have
any length. Other columns are not read, whatever their names. Empty tables give an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import batches, fresh, raw_texts, small_batches, two

WIDTH = 64
T = TypeVar("T")
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_payload(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Lossless 8-bit greyscale image of 64 samples a row, without row filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples, a row per image row. Only images of this module's kind are read."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or (shape[0], shape[2], shape[3]) != (WIDTH, 8, 0):
        raise ValueError("not an 8-bit greyscale image of 64 samples a row")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not used here")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Average hash: 8 x 8 mean samples against their mean, as 16 hex digits."""
    bands = np.linspace(0, len(samples), 9).astype(int)
    total = np.concatenate(([np.zeros(8)], np.cumsum(samples.reshape(len(samples), 8, 8).sum(axis=2, dtype=np.int64), axis=0)))
    cells = (total[bands[1:]] - total[bands[:-1]]) / np.maximum(1, np.diff(bands))[:, None]
    return np.packbits(cells > cells.mean()).tobytes().hex()


class ArchiveWriter:
    """A ZIP file of stored members, written front to back."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.out, self.at, self.directory, self.n = where.open_output_stream(path), 0, [], 0

    def add(self, name: bytes, data: bytes) -> None:
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(name), 0)
        self.directory.append(b"PK\x01\x02\x14\0" + common + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + name)
        head = b"PK\x03\x04" + common + name
        self.out.write(head + data)
        self.at += len(head) + len(data)
        self.n += 1

    def close(self) -> tuple[int, int]:
        """Where the directory begins, and the file's size."""
        directory = b"".join(self.directory)
        end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, self.n, self.n, len(directory), self.at, 0)
        self.out.write(directory + end)
        self.out.close()
        return self.at, self.at + len(directory) + len(end)


def read_directory(file: pa.NativeFile) -> list[tuple[bytes, int, int, int]]:
    """name, offset, size and checksum of each member."""
    size = file.size()
    file.seek(size - 22)
    sign, _, _, _, n, length, at, _ = struct.unpack("<4sHHHHIIH", file.read(22))
    if sign != b"PK\x05\x06":
        raise OSError("the archive has no directory")
    file.seek(at)
    raw, out, k = file.read(length), [], 0
    if len(raw) != length:
        raise OSError("the archive's directory is cut off")
    for _ in range(n):
        crc, packed, _, name_len, extra, note = struct.unpack_from("<IIIHHH", raw, k + 16)
        offset = struct.unpack_from("<I", raw, k + 42)[0]
        out.append((raw[k + 46 : k + 46 + name_len], offset, packed, crc))
        k += 46 + name_len + extra + note
    return out


def again(work: Callable[[], T], tries: int, wait: float) -> T:
    """What the work returns; reading that fails is tried again after a growing wait."""
    for k in range(tries - 1):
        try:
            return work()
        except (OSError, pa.ArrowException):
            time.sleep(wait * 2**k)
    return work()


def open_archive(where: fs.FileSystem, path: str, tries: int, wait: float) -> tuple[pa.NativeFile, list[tuple[bytes, int, int, int]]]:
    """An archive and its directory."""

    def work():
        file = where.open_input_file(path)
        return file, read_directory(file)

    return again(work, tries, wait)


def read_member(where: fs.FileSystem, path: str, file: pa.NativeFile, member: tuple, tries: int, wait: float) -> tuple[bytes, pa.NativeFile]:
    """One member by its offset; a failure reopens the archive and repeats this member alone."""
    _, offset, size, crc = member
    held = [file]

    def work():
        if not held:
            held.append(where.open_input_file(path))
        now = held.pop()
        now.seek(offset)
        head = now.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {offset}")
        skip = sum(struct.unpack_from("<HH", head, 26))
        data = now.read(skip + size)[skip:]
        if zlib.crc32(data) != crc or len(data) != size:
            raise OSError(f"the member at {offset} is damaged")
        return data, now

    return again(work, tries, wait)


class _Ranges(InputPartition):
    """Byte ranges (archive, begin, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


class ArchiveSource(DataSource):
    """Members of the archives that a manifest lists: key, n_bytes (without padding), archive, member_offset, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key string, n_bytes long, archive string, member_offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.manifest = options["path"]
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.tries, self.wait = int(options.get("tries", 4)), float(options.get("wait", 0.1))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.max_partitions = int(options.get("maxpartitions", 100_000))

    def partitions(self) -> list[InputPartition]:
        where, path = fs.FileSystem.from_uri(self.manifest)
        listed = pq.read_table(path, filesystem=where, columns=["archive", "directory"]).sort_by("archive").to_pydict()
        most = max(self.range_bytes, -(-sum(listed["directory"]) // self.max_partitions))
        out, held = [_Ranges([])], 0
        for archive, end in zip(listed["archive"], listed["directory"], strict=True):
            for at in range(0, end, most):
                part = min(most, end - at)
                if held and held + part > most:
                    out.append(_Ranges([]))
                    held = 0
                out[-1].ranges.append((archive, at, at + part))
                held += part
        return out

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for uri, begin, end in partition.ranges:
            where, path = fs.FileSystem.from_uri(uri)
            file, members = open_archive(where, path, self.tries, self.wait)
            for member in members:
                if begin <= member[1] < end:
                    data, file = read_member(where, path, file, member, self.tries, self.wait)
                    n, _, key = member[0].decode().partition(":")
                    if key.startswith("K"):  # a key too long for a member's name stands before the image
                        cut = int(key[1:])
                        key, data = "k" + data[:cut].decode(), data[cut:]
                    rows.append((key[1:] if key else None, int(n), uri, member[1], data))
                    size += len(data)
                    if size >= self.batch_bytes:
                        yield _rows(rows)
                        rows, size = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
        names=["key", "n_bytes", "archive", "member_offset", "media"],
    )


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 64 << 20, level: int = 1) -> str:
    """Store every payload; returns the manifest's path (archive, members, directory, size)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = fresh(spark, "media")

    def run(it):
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        out, done = None, []

        def close():
            directory, size = out.close()
            done.append((f"{folder}/{name}", out.n, directory, size))

        name = ""
        for batch in batches(it):
            for key, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = ArchiveWriter(where, f"{base}/{name}")
                # the byte count before padding travels in the member's name
                name_, data = f"{len(text)}:" + ("" if key is None else f"k{key}"), to_png(to_payload(text), level)
                if len(name_) > 10_000:
                    long = str(key).encode()
                    name_, data = f"{len(text)}:K{len(long)}", long + data
                out.add(name_.encode(), data)
                if out.at >= archive_bytes or out.n >= 60_000:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            cols = list(zip(*done, strict=True))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["archive", "members", "directory", "size"])

    manifest = f"{folder}/manifest.parquet"
    two(docs, id_col, text_col).mapInArrow(run, "archive string, members long, directory long, size long").write.parquet(manifest)
    return manifest


def read_archives(spark: SparkSession, manifest: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(manifest)


def describe(media: DataFrame) -> DataFrame:
    """key, n_bytes, payload and media digests, feature, from the stored bytes as read back."""

    def run(it):
        for batch in batches(it):
            rows: list[tuple] = []
            for key, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "media")), strict=True):
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append(
                    (
                        key,
                        n,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-WIDTH:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        feature(samples),
                    )
                )
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=DIGEST)

    small_batches(media.sparkSession)
    return media.select("key", "n_bytes", "media").mapInArrow(
        run,
        "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


DIGEST = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
