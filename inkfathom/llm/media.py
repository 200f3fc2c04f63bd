"""Media columns kept in archives and read through a custom data source.

Payloads become 8-bit grey PNG pictures, 64 samples wide, gathered in ZIP
archives of bounded size in the shared folder. The data source
``media_archive`` plans byte ranges over the archives; a range owns the members
whose local header begins within it. Its reader finds them in the archive's
directory, reads each by its offset and checks its CRC; a member that fails is
tried again by itself, through a newly opened file, before the task fails. The
payloads stream to Spark as Arrow batches of bounded size.

Defined cases: a null or empty text is a payload of 64 zero bytes, n_bytes 0;
equal payloads have equal media bytes; repeated rows are repeated members; a
null id is kept; an empty table makes no archive and gives no row; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkfathom.llm.common import map_batches, shared_dir

WIDTH = 64
#: Archives are closed at this size, and read in ranges of RANGE bytes, or of
#: such that there are no more than RANGES of them, which bounds what is planned.
ARCHIVE, MEMBERS, RANGE, RANGES = 256 << 20, 100_000, 8 << 20, 50_000
BATCH = 4 << 20
TRIES = 3
#: Fixed values of the PNG and ZIP formats.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
LOCAL_HEADER = "<4s5H3L2H"

FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH) if raw else bytes(WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a 0 before each line: unfiltered
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
            if width != WIDTH or body[8:] != b"\x08\0\0\0\0":
                raise ValueError("another kind of PNG")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    mean = x.mean(dtype=np.float64)
    spread = x.std(dtype=np.float64)
    return f"rows={len(x) // WIDTH};mean={mean:.4f};std={spread:.4f};bins=" + ",".join(map(str, bins.tolist()))


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str | None:
    """Store each text's payload; returns the manifest's path (None: no rows).

    A task writes archives under names of its own attempt; only those that
    finished tasks report get into the manifest, so lost or repeated attempts
    leave nothing that is read.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        stream = archive = None
        k = members = size = 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal archive, stream, k
            if archive is not None:
                archive.close()
                total = stream.tell()
                stream.close()
                done.append((f"{name}-{k}.zip", total, members))
                archive = stream = None
                k += 1

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if archive is None:
                    stream = fs.open_output_stream(f"{name}-{k}.zip")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    members = size = 0
                raw = (text.as_py() or "").encode()
                media = to_png(padded(raw))
                archive.writestr(zipfile.ZipInfo(f"{members}/{doc_id}/{len(raw)}.png"), media)
                members, size = members + 1, size + len(media)
                if size >= ARCHIVE or members >= MEMBERS:
                    close()
        close()
        cols = list(zip(*done)) if done else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))],
            names=["path", "size", "members"],
        )

    # One row for each archive of some 256 MB (or input split): a list of files, as any scan plans one.
    made = map_batches(rows, run, "path string, size bigint, members bigint").collect()
    if not made:
        return None
    fs, root = _opened(folder)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps([[r["path"], r["size"]] for r in sorted(made)]).encode())
    return f"{folder}/manifest.json"


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, manifest: str, step: int, tries: int):
        self.manifest, self.step, self.tries = manifest, step, tries

    def partitions(self) -> list[InputPartition]:
        fs, path = _opened(self.manifest)
        with fs.open_input_stream(path) as f:
            archives = json.loads(f.read())
        step = max(self.step, -(-sum(n for _, n in archives) // RANGES))
        return [ByteRange(p, at, min(at + step, n)) for p, n in archives for at in range(0, n, step)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.manifest)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            own = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
        names, offsets, media, held = [], [], [], 0
        file = None
        try:
            for info in own:
                for attempt in range(self.tries):
                    try:
                        file = file or fs.open_input_file(partition.path)
                        body = member_at(file, info.header_offset, info.file_size, info.CRC)
                        break
                    except (OSError, ValueError):
                        if file is not None:
                            file.close()
                        file = None
                        if attempt + 1 == self.tries:
                            raise
                names.append(info.filename)
                offsets.append(info.header_offset)
                media.append(body)
                held += len(body)
                if held >= BATCH:
                    yield _members(names, offsets, media)
                    names, offsets, media, held = [], [], [], 0
            if names:
                yield _members(names, offsets, media)
        finally:
            if file is not None:
                file.close()


def member_at(file, offset: int, size: int, crc: int) -> bytes:
    """A stored member's bytes, by the offset of its local header."""
    file.seek(offset)
    length = struct.calcsize(LOCAL_HEADER)
    head = struct.unpack(LOCAL_HEADER, file.read(length))
    if head[0] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    file.seek(offset + length + head[-2] + head[-1])
    body = file.read(size)
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError(f"the member at {offset} is damaged")
    return body


def _members(names: list[str], offsets: list[int], media: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())],
        names=["member", "offset", "media"],
    )


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").option("manifest", path).load()``;
    options ``range_bytes`` and ``tries``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, offset bigint, media binary"

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["manifest"], int(o.get("range_bytes", RANGE)), int(o.get("tries", TRIES)))


# The planner's Python process may not see this package, so its parts travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_archives(spark: SparkSession, manifest: str, **options: int) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").options(manifest=manifest, **options).load()


def describe(members: DataFrame) -> DataFrame:
    """Decode each member and compute the columns of ``FEATURES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, media in zip(b.column("member").to_pylist(), b.column("media")):
                _, doc_id, n = name.removesuffix(".png").split("/")
                media = media.as_py()
                payload = from_png(media)
                out.append(
                    (
                        None if doc_id == "None" else int(doc_id),
                        int(n),
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-WIDTH:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        feature(payload),
                    )
                )
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=[x.split()[0] for x in FEATURES.split(", ")],
            )

    return map_batches(members, run, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read the stored bytes back, describe them."""
    spark = docs.sparkSession
    manifest = write_archives(docs, id_col, text_col)
    if manifest is None:
        return spark.createDataFrame([], FEATURES)
    return describe(read_archives(spark, manifest))
