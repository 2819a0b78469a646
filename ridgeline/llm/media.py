"""Media columns: payloads stored as images in archives, and a data source that reads them by byte range.

``store`` writes tar archives of PNG images with Spark's own file writer, so a lost
task leaves nothing behind and any file system will do.  ``MediaArchives`` plans
byte ranges over the files of such a folder without opening one; each range finds
its first member by itself, reads blocks of some MB, cuts members from them into Arrow
batches, and reads a header or a member again from its offset, alone, when it is damaged.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeline.llm.kernels import release, text_blocks, utf8
from ridgeline.llm.shared import new_folder

WIDTH = 576
FILL = 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_RECORD = 512

# ------------------------------------------------------------------ images


def pad(data: bytes) -> bytes:
    """The bytes, with ``FILL`` appended up to a positive multiple of ``WIDTH``."""
    return data + bytes([FILL]) * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image, ``WIDTH`` samples a row.

    No image is a multiple of 512 bytes long: a comment is added to those that
    would be, for archives end each member with a fill byte.
    """
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = samples
    parts = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", zlib.compress(rows.tobytes(), level)), _chunk(b"IEND", b"")]
    if sum(map(len, parts)) % _RECORD == 0:
        parts.insert(2, _chunk(b"tEXt", b"Comment\0"))
    return b"".join(parts)


def from_png(data: bytes) -> bytes:
    """The samples of an image that :func:`to_png` made; ValueError if it is damaged."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, shape = 8, [], None
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or kind != b"IEND":
        raise ValueError("image is cut off")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not read")
    return rows[:, 1:].tobytes()


def check_png(data: bytes) -> None:
    """ValueError unless the chunks of an image are whole and have their checksums; nothing is unpacked."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, kind = 8, b""
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind = data[at + 4 : at + 8]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(memoryview(data)[at + 4 : at + 8 + size]):
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + size
    if kind != b"IEND":
        raise ValueError("image is cut off")


def feature(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and a 64-bit hash of which 64ths lie above the mean."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.float64)
    bounds = np.arange(65) * len(x) // 64
    means = np.add.reduceat(x, bounds[:-1]) / np.diff(bounds)
    bits = int("".join("1" if m > x.mean() else "0" for m in means), 2)
    return f"rows={len(x) // WIDTH};mean={x.mean():.4f};dev={x.std():.4f};hash={bits:016x}"


# ---------------------------------------------------------------- archives


def _head(name: bytes, size: int, kind: bytes) -> bytes:
    head = struct.pack(
        "100s8s8s8s12s12s8s1s100s8s247s", name, b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"%011o\0" % 0,
        b" " * 8, kind, b"", b"ustar\x0000", b"",
    )
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def member(name: str, data: bytes) -> bytes:
    """A tar member without its last fill byte, which the writer adds as the end of a line.

    A name that its header does not hold is kept by an extended header before that, and the
    member's own name tells how long this is, so that it is found from the member.
    """
    raw, before = name.encode(), b""
    if len(raw) > 100 or b"\0" in raw:
        record = b" path=" + raw + b"\n"
        size = len(record) + 1
        while size != len(b"%d" % size) + len(record):
            size += 1
        record = b"%d" % size + record
        before = _head(b"extended", size, b"x") + record + bytes(-size % _RECORD)
        raw = b"#%d-%s.png" % (size, hashlib.sha256(raw).hexdigest().encode())
    return before + _head(raw, len(data), b"0") + data + bytes(-len(data) % _RECORD - 1)


def _name_of(id_text: str | None) -> str:
    """A member's name; ids that begin like another's sign get one of their own."""
    if id_text is None:
        return "-.png"
    return f"{'=' if id_text[:1] in ('-', '=', '#') else ''}{id_text}.png"


def _id_of(name: str) -> str | None:
    text = name.removesuffix(".png")
    return None if text == "-" else text[1:] if text[:1] == "=" else text


def parse_header(head: bytes) -> tuple[str, int] | None:
    """Name and size of a member, or None if the bytes are no member's header."""
    if len(head) < _RECORD or head[257:262] != b"ustar":
        return None
    try:
        total = int(head[148:156].rstrip(b"\0 ") or b"0", 8)
        size = int(head[124:136].rstrip(b"\0 ") or b"0", 8)
    except ValueError:
        return None
    if sum(head[:148]) + 32 * 8 + sum(head[156:]) != total:
        return None
    return head[:100].rstrip(b"\0").decode("utf-8", "replace"), size


def store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each row's text as a member ``<id>.png`` of the archives in the folder ``path``.

    A missing text is an empty one, a missing id's member is ``-``; ids may be of any length.  Repeated rows are stored
    as often, texts of any length whole.  An empty table makes a folder without members.
    """
    picked = docs.select(F.col(id_col).cast("string").alias("id"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text")):
                names = batch.column("id").slice(a, b - a).to_pylist()
                out = [member(_name_of(name), to_png(pad(text))) for name, text in zip(names, texts, strict=True)]
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
        release()

    members = picked.mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


@dataclass
class Range(InputPartition):
    uri: str
    start: int
    end: int


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: member, archive, offset, media.

    Options: ``rangeBytes`` of a partition at most, ``blockBytes`` that are read together,
    ``batchBytes`` of an Arrow batch, ``tries`` of a header or member, ``onError`` ``raise``
    (after the last try) or ``null`` (a damaged member's media is null, and of a damaged
    header the member is, too; what follows begins at the next whole header).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member string, archive string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path = low["path"]
        self.range_bytes = max(_RECORD, int(low.get("rangebytes", 16 << 20)) // _RECORD * _RECORD)
        self.batch_bytes = int(low.get("batchbytes", 4 << 20))
        self.block_bytes = int(low.get("blockbytes", 4 << 20))
        self.tries = int(low.get("tries", 3))
        self.on_error = low.get("onerror", "raise")

    def partitions(self) -> list[Range]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        out = []
        for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(root)), key=lambda x: x.path):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                out += [Range(prefix + info.path, a, min(a + self.range_bytes, info.size)) for a in range(0, info.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in self._members(partition) if partition.uri else ():
            rows.append(row)
            size += len(row[3] or b"")
            if size > self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    def _members(self, part: Range) -> Iterator[tuple]:
        """Members whose header begins in the range: (name, archive, offset, media)."""
        archive = part.uri.rpartition("/")[2]
        blocks = _Blocks(self, part.uri)
        at = 0 if part.start == 0 else self._next(part, part.start)
        while at is not None and at < part.end:
            head = blocks.at(at, _RECORD)
            found = parse_header(head) or self._header(part.uri, at)
            if found is not None and head[156:157] == b"x":
                at += _RECORD + -(-found[1] // _RECORD) * _RECORD  # of the member behind it
            elif found is not None:
                name, size = found
                if name[:1] == "#":
                    name = self._long_name(part.uri, at, name)
                yield name, archive, at, self._media(part.uri, at, size, blocks.at(at + _RECORD, size))
                at += _RECORD + -(-size // _RECORD) * _RECORD
            elif not any(head) and len(head) == _RECORD:
                return  # the empty record that ends an archive
            elif self.on_error == "null":
                yield None, archive, at, None
                at = self._next(part, at + _RECORD)
            else:
                raise ValueError(f"{part.uri} at {at}: damaged header")

    def _header(self, uri: str, at: int) -> tuple[str, int] | None:
        """A header that was found damaged, read again from its offset."""
        for i in range(1, self.tries):
            time.sleep(0.1 * 2 ** (i - 1))
            _handles.pop(uri, None)
            if found := parse_header(self._bytes(uri, at, _RECORD)):
                return found
        return None

    def _long_name(self, uri: str, at: int, name: str) -> str:
        """The name that the extended header before a member keeps."""
        size = int(name[1:].partition("-")[0])
        room = -(-size // _RECORD) * _RECORD
        for i in range(self.tries):
            record = self._bytes(uri, at - room, size)
            raw = record.partition(b"=")[2][:-1]
            if hashlib.sha256(raw).hexdigest() == name.partition("-")[2].removesuffix(".png"):
                return raw.decode()
            _handles.pop(uri, None)
            time.sleep(0.1 * 2**i)
        if self.on_error == "null":
            return name
        raise ValueError(f"{uri} at {at}: damaged extended header")

    def _next(self, part: Range, start: int) -> int | None:
        """The first member at or after a place of the range: a valid header with an image behind it."""
        step = 1 << 20
        for base in range(start, part.end, step):
            data = self._bytes(part.uri, base, step + _RECORD + 8)
            for at in range(0, min(step, part.end - base), _RECORD):
                if data[at + 257 : at + 262] == b"ustar" and parse_header(data[at : at + _RECORD]) and data[at + _RECORD : at + _RECORD + 8] == _SIGNATURE:
                    return base + at
        return None

    def _bytes(self, uri: str, offset: int, size: int) -> bytes:
        for i in range(self.tries):
            try:
                return _open(uri).read_at(size, offset)
            except OSError:
                _handles.pop(uri, None)
                if i + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**i)
        raise AssertionError

    def _media(self, uri: str, offset: int, size: int, data: bytes) -> bytes | None:
        """A member's bytes, verified, and read again by themselves if damaged or cut."""
        for i in range(self.tries):
            if i:
                data = self._bytes(uri, offset + _RECORD, size)
            try:
                if len(data) == size:
                    check_png(data)
                    return data
                raise ValueError("member is cut off")
            except (ValueError, zlib.error, struct.error) as e:
                _handles.pop(uri, None)
                if i + 1 == self.tries:
                    if self.on_error == "null":
                        return None
                    raise ValueError(f"{uri} at {offset}: {e}") from e
                time.sleep(0.1 * 2**i)
        return None


class _Blocks:
    """A file's bytes by blocks, the last one held."""

    def __init__(self, reader: ArchiveReader, uri: str):
        self.reader, self.uri, self.start, self.data = reader, uri, 0, b""

    def at(self, offset: int, size: int) -> bytes:
        """Bytes from an offset on, fewer at the file's end."""
        low = offset - self.start
        if low < 0 or low + size > len(self.data):
            self.start, low = offset, 0
            self.data = self.reader._bytes(self.uri, offset, max(size, self.reader.block_bytes))
        return self.data[low : low + size]


_handles: dict[str, pa.NativeFile] = {}


def _open(uri: str) -> pa.NativeFile:
    """The open file, one at a time."""
    if uri not in _handles:
        _handles.clear()
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        _handles[uri] = fs.open_input_file(path)
    return _handles[uri]


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members of all archives in a folder: ``member, archive, offset, media``; none of an empty folder.  Options: :class:`MediaArchives`."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def described(members: DataFrame) -> DataFrame:
    """``id`` (as text; null for that of a missing one) of each member, and sizes, digests and the feature of what is stored.

    Where the media is missing, so is all but the id; repeated members are alike, and no members give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            column = batch.column("media")
            for i, name in enumerate(batch.column("member").to_pylist()):
                if not column[i].is_valid:
                    rows.append((name and _id_of(name), *[None] * 7))
                    continue
                media = column[i].as_py()
                payload = from_png(media)
                rows.append((
                    _id_of(name), len(payload.rstrip(bytes([FILL]))), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload),
                ))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_DESCRIBED)

    out = members.select("member", "media").mapInArrow(
        run, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out


_DESCRIBED = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts in the shared folder, read them back and describe them: see :func:`store` and :func:`described`.

    Every value comes from the bytes read back.  Equal texts have equal values; a
    missing or empty text is one row of fill.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    store(docs, folder, id_col=id_col, text_col=text_col)
    return described(read(spark, folder)).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
