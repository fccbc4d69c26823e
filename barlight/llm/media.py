"""Media columns: texts stored losslessly as PNG pixels in archives, read back through a Spark data source.

An archive is a file of members, each a small header and a PNG, with an index file of member offsets beside it.
The data source plans byte ranges over the archives of a folder, streams the members of a range in Arrow
batches, and retries a member that fails its checksum on its own, by its offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from barlight.llm.common import fresh_path, tidy

#: Pixels are RGB and a row has 64 of them, so a row is 192 bytes of payload.
WIDTH, ROW = 64, 192
HEAD, HEAD_SIZE = "<4s?qQQI", struct.calcsize("<4s?qQQI")  # magic, id is null, id, unpadded bytes, stored bytes, CRC-32 of the stored bytes
MAGIC = b"BMA1"
SCHEMA = "doc_id long, archive string, position long, n_bytes long, media binary, error string"


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """8-bit RGB PNG of 64 pixels a row; every row has filter 0, so the pixels are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The pixels of what to_png() wrote; ValueError if a chunk is damaged."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered row")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean and deviation of each channel, and which of two neighbouring pixel columns is brighter (64 bits)."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3).astype(np.float64)
    mean, dev = pixels.mean(axis=(0, 1)), pixels.std(axis=(0, 1))
    columns = pixels.sum(axis=(0, 2))
    bits = np.packbits(columns > np.roll(columns, -1)).tobytes().hex()
    return f"rows={len(pixels)};mean={','.join(f'{x:.4f}' for x in mean)};std={','.join(f'{x:.4f}' for x in dev)};bright={bits}"


class Written(WriterCommitMessage):
    def __init__(self, name: str, members: int, size: int):
        self.name, self.members, self.size = name, members, size


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, text), each task one archive. A job's archives appear with its manifest, once all tasks are
    done; the manifests of a folder add up, and a job that overwrites removes those before it."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        name, offsets, size = f"part-{uuid.uuid4().hex}.bma", [], 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    data = (text.as_py() or "").encode()
                    media, key = to_png(padded(data)), doc_id.as_py()
                    out.write(struct.pack(HEAD, MAGIC, key is None, key or 0, len(data), len(media), zlib.crc32(media)))
                    out.write(media)
                    offsets.append(size)
                    size += HEAD_SIZE + len(media)
        with store.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return Written(name, len(offsets), size)

    def commit(self, messages: list) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder)
        before = manifests(store, folder) if self.overwrite else []
        listed = [{"name": m.name, "members": m.members, "size": m.size} for m in messages if m is not None and m.members]
        new = f"{folder}/manifest-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{new}.tmp") as out:
            out.write(json.dumps(listed).encode())
        store.move(f"{new}.tmp", f"{new}.json")
        for old in before:
            store.delete_file(old)

    def abort(self, messages: list) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")
                store.delete_file(f"{folder}/{m.name}.idx")


def manifests(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int, retries: int, batch: int):
        self.path, self.split, self.retries, self.batch = path, split, retries, batch

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.path)
        listed = []
        for name in manifests(store, folder):
            with store.open_input_stream(name) as f:
                listed += json.loads(f.read())
        ranges = [Range(x["name"], a, min(a + self.split, x["size"])) for x in listed for a in range(0, x["size"], self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, folder = fs.FileSystem.from_uri(self.path)
        where = f"{folder}/{partition.archive}"
        with store.open_input_stream(f"{where}.idx") as f:
            offsets = np.frombuffer(f.read(), "<i8")
        rows, held = [], 0
        with store.open_input_file(where) as f:
            for at in offsets[(offsets >= partition.start) & (offsets < partition.end)].tolist():
                row = self.member(store, where, at, f)
                rows.append((row[0], partition.archive, at, *row[1:]))
                held += len(row[2] or b"")
                if held >= self.batch:
                    yield as_batch(rows)
                    rows, held = [], 0
        if rows:
            yield as_batch(rows)

    def member(self, store: fs.FileSystem, where: str, at: int, f) -> tuple:
        """doc_id, n_bytes, media, error of the member at an offset; each retry opens the archive anew."""
        why = ""
        for k in range(self.retries + 1):
            try:
                if k:
                    with store.open_input_file(where) as again:
                        return (*read_member(again, at), None)
                return (*read_member(f, at), None)
            except (OSError, ValueError, struct.error) as e:
                why = f"{type(e).__name__}: {e}"
        return None, None, None, why


def read_member(f, at: int) -> tuple:
    f.seek(at)
    magic, null, key, n, size, crc = struct.unpack(HEAD, f.read(HEAD_SIZE))
    if magic != MAGIC:
        raise ValueError("no member starts here")
    media = f.read(size)
    if len(media) < size or zlib.crc32(media) != crc:
        raise ValueError("checksum differs")
    return None if null else key, n, media


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    names = ("doc_id", "archive", "position", "n_bytes", "media", "error")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class MediaArchive(DataSource):
    """Format "media_archive". Options: path, split_bytes, retries, batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("split_bytes", 8 << 20)), int(o.get("retries", 2)), int(o.get("batch_bytes", 2 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Stores doc_id and text of every row, beside what the folder has or (mode "overwrite") in its place.

    Null texts are empty, null ids stay null, equal rows are members each, an empty table adds none; a text is one
    member however long, so the longest must fit a task's memory; other columns are not read.
    """
    docs.sparkSession.dataSource.register(MediaArchive)
    kept = docs.select("doc_id", "text")
    kept.select(kept.doc_id.cast("long").alias("doc_id"), kept.text.cast("string").alias("text")).write.format("media_archive").mode(mode).save(path)


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def digests(media: DataFrame) -> DataFrame:
    """Digests and features of members; a member that could not be read fails the query with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["error"]:
                    raise OSError(f"{x['archive']} at {x['position']}: {x['error']}")
                payload = from_png(x["media"])
                out.append((x["doc_id"], x["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                            len(x["media"]), hashlib.sha256(x["media"]).hexdigest(), feature(payload)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                 "media_bytes long, media_sha256 string, feature string")


@tidy
def op10_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "media")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(read_archives(spark, path))


QUERIES = {"op10_media_archive": op10_media_archive}
ORACLES: dict[str, str] = {}
