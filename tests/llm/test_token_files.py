import io
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from depsight.llm import token_files as T
from depsight.llm.common import scratch_path
from depsight.llm.queries import tokenizer_path

from . import cases

PATH = tokenizer_path("byte_bpe_50k.json")


def ids(text):
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    return np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_library():
    texts = [t or "" for _, t in cases.texts()] + ["it's  a\n\n test 's'' ²³ ×÷ a_b\t\r\n x", "   lead", "trail  \n", "<|endoftext|>", "a\xa0b", "İŉǅ ƻ", "don't we'll I'M", "x\n\n\n", "\r\n"]
    e = T.Encoder(PATH, keep=20)
    for _ in range(2):
        assert e(texts) == [ids(t) for t in texts]


def test_round_trip(spark):
    rows = sorted(cases.texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(T.encode_round_trip(cases.frame(spark), PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    at, want, have = 0, [], []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        have.append((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]))
    for i, t in rows:
        b = ids(t or "") + (2).to_bytes(4, "little")
        want.append((str(i), len(b) // 4, zlib.crc32(b)))
    assert sorted(have) == sorted(want)
    assert T.encode_round_trip(cases.frame(spark, []), PATH).count() == 0


def written(docs):
    sink = io.BytesIO()
    w = T.Writer(sink)
    for d, b in docs:
        w.add(d, b)
    w.close()
    return sink.getvalue()


def test_reader_decompresses_only_what_is_asked(monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 10)
    monkeypatch.setattr(T, "PIECE_IDS", 16)
    docs = [(None, b"")] + [(k, np.arange(k * 3, dtype="<u4").tobytes()) for k in range(30)] + [(30, b"abcd"), (30, b"efgh")]
    raw = written(docs)
    r = T.Reader(io.BytesIO(raw))
    assert list(r.documents()) == docs
    r = T.Reader(io.BytesIO(raw))
    assert r.get(20) == [docs[21][1]] and r.frames_read < 8
    assert r.get(30) == [b"abcd", b"efgh"] and r.get(99) == []


def test_frames_are_plain_zstandard_and_checked():
    raw = bytearray(written([(1, b"\x01\0\0\0" * 400), (2, b"\x02\0\0\0")]))
    out = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert out.endswith(b"\x02\0\0\0")
    r = T.Reader(io.BytesIO(bytes(raw)))
    at, size, _, _ = r.frames[0]
    raw[-13 - 12] ^= 1  # the checksum of the first frame
    with pytest.raises(ValueError):
        list(T.Reader(io.BytesIO(bytes(raw))).documents())
    assert at == 0 and size > 0


def test_files_per_partition_are_ordered(spark):
    m = T.write(cases.frame(spark, [(k, f"text {k}") for k in range(300)]).repartition(7), PATH, scratch_path(spark, "t"))
    assert m.agg({"docs": "sum"}).first()[0] == 300
