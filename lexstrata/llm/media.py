"""Media columns: content-addressed payloads in tar shards.

A payload is stored once per shard as a grey image (PNG, 8-bit samples, 64 to a row) under its digest; the catalogue
has its shard, offset and length. Metadata come from a range read of the image header alone; features from a range
read of the whole image, whose samples give the payload back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch

ROW, HEADER = 64, 33
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of the row."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """8-bit grey, ROW samples to a row; the same payload always gives the same bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", header[16:25])


def from_png(image: bytes) -> bytes:
    width, height, _ = png_size(image[:HEADER])
    at, data = 8, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A difference hash of the image: 8 x 9 block means, a bit where a mean exceeds the one to its left; 16 hex digits."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    total = np.zeros((len(image) + 1, ROW + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    r, c = np.linspace(0, len(image), 9).astype(int), np.linspace(0, ROW, 10).astype(int)
    sums = total[np.ix_(r[1:], c[1:])] - total[np.ix_(r[:-1], c[1:])] - total[np.ix_(r[1:], c[:-1])] + total[np.ix_(r[:-1], c[:-1])]
    area = np.outer(np.maximum(np.diff(r), 1), np.diff(c))
    means = sums * (10**6) // area
    bits = (means[:, 1:] > means[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


#: How the names that Hadoop gives to stores read elsewhere.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def store_uri(uri: str) -> str:
    """A Hadoop URI as the file systems of Arrow know it; a bare path is a local one."""
    scheme, there, rest = uri.partition("://")
    if there:
        return f"{_SCHEMES.get(scheme.lower(), scheme.lower())}://{rest}"
    return "file://" + (uri[5:] if uri.startswith("file:") else uri)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(store_uri(uri))


class ShardWriter:
    """Tar files of bounded size; a name of its own for every attempt, so a repeated task never meets an old file."""

    def __init__(self, folder: str):
        self.folder, self.out, self.at, self.seen = folder, None, 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if digest in self.seen:
            return self.seen[digest]
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.uri, self.at, self.seen = f"{self.folder}/{uuid.uuid4().hex}.tar", 0, {}
            where, path = _open(self.uri)
            self.out = where.open_output_stream(path)
        image = to_png(payload)
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(image)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + image + bytes(-len(image) % 512))
        self.seen[digest] = place = (self.uri, self.at + len(head), len(image))
        self.at += len(head) + len(image) + (-len(image) % 512)
        return place

    def __enter__(self) -> ShardWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes the payloads of docs to tar shards in folder; (doc_id, n_bytes, digest, shard, at, media_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        with ShardWriter(folder) as writer:
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part, rows = batch.slice(k, 512), []
                    for text in part.column("text").to_pylist():
                        data = (text or "").encode()
                        payload = pad(data)
                        digest = hashlib.sha256(payload).hexdigest()
                        rows.append((len(data), digest, *writer.put(digest, payload)))
                    n, digest, shard, at, size = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "digest": digest, "shard": shard, "at": pa.array(at, pa.int64()), "media_bytes": pa.array(size, pa.int64())})

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, digest string, shard string, at bigint, media_bytes bigint")
    return scratch.save(rows, "rows")


def read_headers(catalogue: DataFrame) -> DataFrame:
    """The catalogue with width, height and bits, read from the first HEADER bytes of each image and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *header_columns(b)], names=[*b.schema.names, "width", "height", "bits"])

    kinds = ", ".join(f"{c} {t}" for c, t in catalogue.dtypes)
    return catalogue.mapInArrow(run, f"{kinds}, width bigint, height bigint, bits bigint")


def header_columns(b: pa.RecordBatch) -> list[pa.Array]:
    """Width, height and bits of the images of a batch of (shard, at, media_bytes)."""
    out = np.zeros((b.num_rows, 3), np.int64)
    for shard, at in _ranges(b):
        with _reader(shard) as f:
            for k, offset, _ in at:
                f.seek(offset)
                out[k] = png_size(f.read(HEADER))
    return [pa.array(out[:, i]) for i in range(3)]


def _reader(shard: str):
    where, path = _open(shard)
    return where.open_input_file(path)


def _ranges(b: pa.RecordBatch) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """By shard, the rows of the batch in the order of their offsets."""
    by: dict[str, list[tuple[int, int, int]]] = {}
    for k, (shard, at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "at", "media_bytes")), strict=True)):
        by.setdefault(shard, []).append((k, at, n))
    return [(s, sorted(v, key=lambda x: x[1])) for s, v in by.items()]


def read_back(catalogue: DataFrame) -> DataFrame:
    """The catalogue (digest, shard, at, media_bytes) with what its stored bytes say: width, height and bits from a range
    read of the header alone; payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature from one of the image."""
    schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                heads, digests, out = header_columns(b), b.column("digest").to_pylist(), [None] * b.num_rows
                for shard, at in _ranges(b):
                    with _reader(shard) as f:
                        for k, offset, n in at:
                            f.seek(offset)
                            image = f.read(n)
                            payload = from_png(image)
                            sha = hashlib.sha256(payload).hexdigest()
                            if sha != digests[k]:
                                raise ValueError(f"{shard} at {offset} does not hold {digests[k]}")
                            out[k] = (len(payload), sha, zlib.crc32(payload[-ROW:]), hashlib.sha256(image).hexdigest(), feature_of(payload))
                cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([*b.columns, *heads, *(pa.array(c, f.type) for c, f in zip(cols, schema, strict=True))], names=[*b.schema.names, "width", "height", "bits", *schema.names])

    kind = "width bigint, height bigint, bits bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string"
    return catalogue.select("digest", "shard", "at", "media_bytes").mapInArrow(run, f"digest string, shard string, at bigint, media_bytes bigint, {kind}")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes (length), media_sha256, feature; then digest,
    shard, at (offset) and the rest of what read_back finds there.

    A null text counts as empty; an empty text is one row of zeros. A text of any length is one payload, held whole by
    its task. Equal texts have equal values: a shard stores them once, and all rows of a digest point at the one copy that
    is read back. Repeated rows stay; a null doc_id is kept; other columns are ignored; no documents give no rows.
    folder: where the shards go, by default into the shared folder; they stay there, as the rows point at them.
    """
    scratch = Scratch(docs.sparkSession)
    rows = store(docs, folder or scratch.path("shards"), scratch)
    catalogue = rows.groupBy("digest").agg(F.min(F.struct("shard", "at", "media_bytes")).alias("x")).select("digest", "x.*")
    found = scratch.save(read_back(catalogue.repartitionByRange("shard", "at")), "found")
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    both = rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
    return both.select(*first, *[c for c in both.columns if c not in first])
