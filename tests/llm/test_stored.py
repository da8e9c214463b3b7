import hashlib
import random
import tarfile
import zlib

import public_tokenizers
import pytest
import sentencepiece

from lexstrata.llm import media
from lexstrata.llm.common import Scratch, read
from lexstrata.llm.sentencepiece_bpe import encode_documents, loaded

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   a   b  ", "\n\n x\ty\r\n", "tokenization▁of  ▁▁words", "日本語のテキスト 🙂🙃 \u0000 � é", "a" * 5000, " " * 5000, "<s> </s> <unk> <0x0A>",
    "the nbsp ​zero", "".join(map(chr, range(32, 400))), "ab " * 3000, "▁", "\U0001f468‍\U0001f469‍\U0001f467 supercalifragilisticexpialidocious",
]


def test_encode_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table, _ = loaded(MODEL)
    rng = random.Random(1)
    alphabet = "aeiourstlnmdch    \n▁ABé中.,0123-=(){}"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    real = [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    for text in [*[t or "" for t in ODD], *made, *real]:
        assert table.encode(text)[0] == sp.encode(text), repr(text[:200])


def test_encode_documents(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(None if i == 3 else i, t, i) for i, t in enumerate(ODD)] + [(1, "", 9)], "doc_id long, text string, n_tokens int")
    got = encode_documents(docs, MODEL, with_ids=True).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        ids = sp.encode(ODD[3 if r.doc_id is None else r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()
    assert encode_documents(docs.limit(0), MODEL).count() == 0


def test_media_round_trip(spark):
    texts = [*ODD, "x" * 64, "x" * 65, "x" * 200_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts * 2)], "doc_id long, text string, digest string")
    assert media.media_columns(docs).columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = media.media_columns(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(2 * len(texts)))
    for r in got:
        data = (texts[r.doc_id % len(texts)] or "").encode()
        n = max(64, -(-len(data) // 64) * 64)
        payload = data + bytes(n - len(data))
        image = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), n, hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())
        assert r.feature == media.feature_of(payload) and (r.width, r.height) == (64, n // 64)
    assert media.media_columns(docs.limit(0)).count() == 0


def independent(image):
    """Width, height and samples of a grey PNG by the format's own rules, with every filter type."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data = 8, b""
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, depth, colour = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9]
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    assert (depth, colour) == (8, 0)
    raw, rows, last = zlib.decompress(data), [], bytes(width)
    for k in range(height):
        line = raw[k * (width + 1) : (k + 1) * (width + 1)]
        assert line[0] in (0, 2)
        last = bytes((v + (p if line[0] == 2 else 0)) % 256 for v, p in zip(line[1:], last, strict=True))
        rows.append(last)
    return width, height, b"".join(rows)


def plain_feature(payload):
    """A bit for each of 8 x 8 neighbouring blocks of an 8 x 9 grid: whether the right one's mean is above the left one's."""
    rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]
    cut = lambda n, parts: [int(i * n / parts) for i in range(parts + 1)]
    r, c, bits = cut(len(rows), 8), cut(64, 9), ""
    for a, b in zip(r, r[1:]):
        means = []
        for x, y in zip(c, c[1:]):
            cells = [v for row in rows[a:b] for v in row[x:y]]
            means.append(sum(cells) * 10**6 // max(1, (b - a if b > a else 1) * (y - x)))
        bits += "".join("1" if q > p else "0" for p, q in zip(means, means[1:]))
    return f"{int(bits, 2):016x}"


def test_stored_bytes_by_an_independent_decoder(spark, tmp_path):
    """Every row's shard, offset and length hold its text; the feature and the header's columns follow from those bytes."""
    texts = [*ODD, "x" * 65, "".join(chr(97 + i * i % 26) for i in range(20_000))]
    docs = spark.createDataFrame([(None if i == 4 else i, t) for i, t in enumerate(texts)] + [(0, texts[5]), (0, texts[5])], "doc_id long, text string").repartition(4)
    got = media.media_columns(docs, f"file://{tmp_path}/s").collect()
    assert len(got) == len(texts) + 2 and sum(r.doc_id is None for r in got) == 1
    for r in got:
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.at)
            image = f.read(r.media_bytes)
        width, height, payload = independent(image)
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 and hashlib.sha256(payload).hexdigest() == r.payload_sha256 == r.digest
        assert (r.width, r.height, r.bits) == (width, height, 8) and r.feature == plain_feature(payload)
    assert len({(r.shard, r.at) for r in got}) == len({r.digest for r in got})
    want = sorted(hashlib.sha256(media.pad((t or "").encode())).hexdigest() for t in [*texts, texts[5], texts[5]])
    assert sorted(r.digest for r in got) == want


def test_headers_read_no_more_than_headers(spark, tmp_path, monkeypatch):
    rows = media.store(spark.createDataFrame([(i, "long text " * 5_000 + str(i)) for i in range(5)], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/s", Scratch(spark))
    batch, read = rows.select("shard", "at", "media_bytes").toArrow().to_batches()[0], []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    plain = media._reader
    monkeypatch.setattr(media, "_reader", lambda shard: Counted(plain(shard)))
    width, height, bits = media.header_columns(batch)
    assert read == [media.HEADER] * 5 and set(width.to_pylist()) == {64} and set(bits.to_pylist()) == {8} and min(height.to_pylist()) > 700


def test_store_uris():
    assert [media.store_uri(x) for x in ("s3a://b/k", "wasbs://c@a/k", "file:///tmp/x", "file:/tmp/x", "/tmp/x", "hdfs://h:1/x")] == ["s3://b/k", "abfss://c@a/k", "file:///tmp/x", "file:///tmp/x", "file:///tmp/x", "hdfs://h:1/x"]


def test_shards_are_tar_files_with_headers(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string").coalesce(1)
    rows = media.store(docs, f"file://{tmp_path}/s", Scratch(spark))
    heads = media.read_headers(rows).collect()
    assert {(r.width, r.height, r.bits) for r in heads} == {(64, 1, 8)}
    names = [m.name for p in (tmp_path / "s").iterdir() for m in tarfile.open(p).getmembers()]
    assert sorted(names) == sorted({r.digest + ".png" for r in heads}) and len(names) == 3


def test_a_damaged_shard_is_noticed(spark, tmp_path):
    rows = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), f"file://{tmp_path}/s", Scratch(spark))
    (shard,) = (tmp_path / "s").iterdir()
    raw = bytearray(shard.read_bytes())
    raw[rows.first()["at"] + 20] ^= 0xFF
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="cannot reshape|does not hold|Error"):
        media.read_back(rows).collect()
