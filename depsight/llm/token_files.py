"""Token ids in seekable binary files.

A file is a run of independent zstandard frames, a skippable index frame and a trailing seek table in the public
seekable format (sizes and a checksum of each frame), so any zstandard tool can decompress it, and a reader
decompresses only the frames of the documents asked for. A data frame holds whole entries: their count, their heads
(doc_id, flags, number of ids) and their ids, little-endian unsigned 32-bit. Flags: 1 null doc_id, 2 continued from
the frame before. The index has the first doc_id of each data frame.

Documents are range-partitioned by doc_id and sorted; each task writes one file under a name of its attempt and moves
it into place, so that repeated or speculative tasks leave one whole file.

Defined results: null text is empty, which has only the end id; null ids come first, equal ids next to each other in
no given order; empty tables give no file and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, cut, id_text, scratch_path

#: Fixed values of the public seekable format.
SKIP_TABLE, SKIP_INDEX, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
FRAME_IDS, PIECE_IDS, END_ID = 1 << 16, 1 << 20, 2
NO_ID, MORE = 1, 2


def _class(kinds: str) -> str:
    """Members of a regex class: characters of the plain range whose Unicode category starts with one of these letters."""
    return "".join(re.escape(c) for c in map(chr, PLAIN) if unicodedata.category(c)[0] in kinds)


#: Characters whose classes no Unicode version disputes: printable ASCII, Latin-1 and the Latin extensions.
PLAIN = [*range(0x20, 0x7F), *range(0xA1, 0x250)]
ENCODERS: dict[str, Encoder] = {}
#: Byte-level BPE writes printable bytes as themselves and the others, in order, as the characters from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
SAMPLES = [" ".join(map(chr, PLAIN)), "".join(map(chr, PLAIN)), "It's  we'll\tthey've\n\n 12a3 \r\nx!? ...end \u00e9t\u00e9 \u00df 'tis \n", ""]


class Encoder:
    """Ids of texts as the tokenizers library gives them, as little-endian uint32 bytes.

    A byte-level BPE cuts a text by a fixed pattern and encodes each cut on its own. For texts of plain characters,
    the cuts are made here, and the library's model encodes each distinct cut once; any other text or kind of
    tokenizer goes to the library whole. With ``added``, the tokenizer's added tokens are recognised in a text, as an
    unmodified tokenizer does, and texts that hold one go to the library whole; without, they are plain text.
    At its start an encoder compares both ways on sample texts; where another version of the library differs, all
    texts go to it whole.
    """

    ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")

    def __init__(self, path: str, keep: int = 400_000, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not added
        made = json.loads(self.lib.to_str())
        contents = [t["content"] for t in made.get("added_tokens") or [] if added]
        self.whole = re.compile("|".join(map(re.escape, contents))).search if contents else None
        pre = made.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and not any("\n" in c for c in contents)
        letter, digit = _class("L"), _class("N")
        # The fixed pattern of byte-level BPE, for plain characters; letters come first, as no other branch starts with one.
        cuts = rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digit}]+| ?[^ \t\n\r{letter}{digit}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
        self.cut = re.compile(cuts).findall if plain else None
        self.known = Memo(self.word, keep)
        if plain and self(SAMPLES) != self.library(SAMPLES):
            self.cut = None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process, which serves many tasks."""
        if path not in ENCODERS:
            ENCODERS[path] = cls(path, added=True)
        return ENCODERS[path]

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, cut: str) -> bytes:
        """Ids of a single cut, by the library's model alone."""
        return array("I", [t.id for t in self.lib.model.tokenize(cut.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self.library(texts)
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.ODD.search(t) or (self.whole and self.whole(t))]
        for i, ids in zip(odd, self.library([texts[i] for i in odd]) if odd else ()):
            out[i] = ids
        known = self.known.__getitem__
        return [b"".join(map(known, self.cut(t))) if ids is None else ids for t, ids in zip(texts, out)]


def place_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, sink, level: int = 3):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table, self.firsts = [], []
        self.heads, self.bodies, self.held = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for at in range(0, max(len(ids), 1), 4 * PIECE_IDS):
            piece = ids[at : at + 4 * PIECE_IDS]
            self.heads.append((doc_id or 0, (doc_id is None) * NO_ID + (at > 0) * MORE, len(piece) // 4))
            self.bodies.append(piece)
            self.held += len(piece) // 4
            if self.held >= FRAME_IDS:
                self.flush()

    def _put(self, compressed: bytes, raw: bytes) -> None:
        self.sink.write(compressed)
        self.table.append((len(compressed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.heads:
            raw = b"".join([struct.pack("<I", len(self.heads)), *(struct.pack("<qII", *h) for h in self.heads), *self.bodies])
            self.firsts.append(self.heads[0][:2])
            self._put(self.zip.compress(raw), raw)
            self.heads, self.bodies, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qI", *x) for x in self.firsts)
        skip = struct.pack("<II", SKIP_INDEX, len(index)) + index
        self._put(skip, b"")
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_TABLE, len(table)) + table)


class Reader:
    """source: a seekable binary file."""

    def __init__(self, source):
        self.source, self.unzip, self.frames_read = source, zstandard.ZstdDecompressor(), 0
        size = source.seek(0, 2)
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * count)
        table = struct.iter_unpack("<III", source.read(12 * count))
        at, self.frames = 0, []
        for packed, raw, check in table:
            self.frames.append((at, packed, raw, check))
            at += packed
        at, packed, _, _ = self.frames.pop()
        source.seek(at + 8)
        self.firsts = [(d, f & NO_ID) for d, f in struct.iter_unpack("<qI", source.read(packed - 8))]

    def frame(self, k: int) -> Iterator[tuple[int | None, int, bytes]]:
        at, packed, size, check = self.frames[k]
        self.source.seek(at)
        raw = self.unzip.decompress(self.source.read(packed), max_output_size=size)
        self.frames_read += 1
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        (count,) = struct.unpack_from("<I", raw)
        at = 4 + 16 * count
        for doc_id, flags, n in struct.iter_unpack("<qII", raw[4:at]):
            yield (None if flags & NO_ID else doc_id), flags, raw[at : at + 4 * n]
            at += 4 * n

    def documents(self, frames: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        held: list | None = None
        for k in range(len(self.frames)) if frames is None else frames:
            for doc_id, flags, ids in self.frame(k):
                if flags & MORE and held:
                    held[1].append(ids)
                else:
                    if held:
                        yield held[0], b"".join(held[1])
                    held = None if flags & MORE else [doc_id, [ids]]
        if held:
            yield held[0], b"".join(held[1])

    def get(self, doc_id: int) -> list[bytes]:
        """The ids of each document of this doc_id; only their frames are decompressed."""
        keys = [(not null, d) for d, null in self.firsts]
        want = (True, doc_id)
        first = max(0, sum(k < want for k in keys) - 1)
        last = sum(k <= want for k in keys)
        return [ids for d, ids in self.documents(range(first, last)) if d == doc_id]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID) -> DataFrame:
    """Files in doc_id order; the manifest (part, uri, docs, tokens)."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, out = Encoder.of(tokenizer), TaskContext.get(), None
        fs, root = place_of(path)
        end, n_docs, n_ids = b"" if end_id is None else struct.pack("<I", end_id), 0, 0
        final = f"{root}/part-{task.partitionId():06d}.zst"
        draft = f"{final}.{task.taskAttemptId()}.tmp"
        for b in batches(it, 256):
            if out is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(draft)
                out = Writer(sink)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                out.add(doc_id, ids + end)
                n_docs, n_ids = n_docs + 1, n_ids + (len(ids) + len(end)) // 4
        if out is not None:
            out.close()
            sink.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [f"part-{task.partitionId():06d}.zst"], "docs": [n_docs], "tokens": [n_ids]})

    ranged = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    made = cut(ranged.mapInArrow(run, "part int, name string, docs long, tokens long"))
    return made.select("part", F.concat(F.lit(path + "/"), "name").alias("uri"), "docs", "tokens")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files of a manifest."""
    spark, at, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect()):  # a row for each file
        rows.append((r["uri"], at))
        at += r["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in it:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist()):
                fs, name = place_of(uri)
                with fs.open_input_file(name) as source:
                    held = []
                    for doc_id, ids in Reader(source).documents():
                        held.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names)

    return spark.createDataFrame(rows, "uri string, start long").repartition(len(rows)).mapInArrow(run, schema)


def encode_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read(write(docs, tokenizer, scratch_path(docs.sparkSession, "tokens")))
