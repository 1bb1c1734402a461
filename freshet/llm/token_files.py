"""Token ids in seekable zstandard files.

A file holds one independent zstandard frame per document (its ids as little-endian unsigned 32-bit integers), then a
skippable frame with the documents' ids and counts, then the seek table in a skippable frame at the very end: compressed
size, size and XXH64 checksum (low 32 bits) of every frame, and a footer. A reader fetches the tail, looks a document up and
reads and checks only its frame. Files are written to and read from the shared folder through Arrow's file systems.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import fresh_path, parallelism

END_ID = 1
LEVEL = 1
#: Pieces and tokens a worker remembers before it starts anew, and how many of them may be tokens of several pieces.
CACHE, TOKENS = 1_200_000, 300_000
#: What keeps a text from the quick way, as do the beginnings of special tokens: signs beyond the Latin letters, odd white space.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]")
_LETTERS, _DIGITS = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_PIECE = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTERS}{_DIGITS} \\t-\\r]+")
_INDEX, _TABLE, _FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80
_NULL = -(1 << 63)
_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())])


class Encoder:
    """Ids of texts as bytes. The vocabulary works on lower-cased runs of letters, single digits and runs of other signs, so
    their ids are remembered; the result equals that of encoding the whole text.

    Texts of ASCII and Latin letters are cut at white space, which no piece spans, into tokens, and those not met before into
    such pieces; new pieces are encoded together and told apart by the ids that end a piece. Any other text is cut at spaces
    and line feeds only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts, self.tokens = Tokenizer.from_file(path), {}, {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 2_000):
            some = pieces[at : at + 2_000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and (not len(ids) or last[-1] == len(ids)):
                raw, start = ids.tobytes(), 0
                for piece, end in zip(some, (last * 4).tolist()):
                    self.known[piece], start = raw[start:end], end
            else:
                self.known |= {piece: self._plain(piece) for piece in some}

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or _ODD.search(text):
            chunks = text.replace("\n", " ").split(" ")
            if len(self.parts) > CACHE // 8:
                self.parts.clear()
            for chunk in set(chunks):
                if chunk not in self.parts:
                    self.parts[chunk] = self._plain(chunk)
            return b"".join(map(self.parts.__getitem__, chunks))
        tokens = text.lower().split()
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            return self._meet(tokens)

    def _meet(self, tokens: list[str]) -> bytes:
        """The ids of tokens some of which are not known."""
        known, found = self.known, _PIECE.findall
        cut = {t: found(t) for t in set(tokens) if t not in known}
        new = {p for pieces in cut.values() for p in pieces if p not in known}
        if len(known) + len(new) > CACHE and known:
            known.clear()
            self.tokens = 0
            return self._meet(tokens)
        self._learn(list(new))
        made = {t: b"".join([known[p] for p in pieces]) for t, pieces in cut.items() if t not in known}
        out = b"".join([known[t] if t in known else made[t] for t in tokens])
        if self.tokens + len(made) <= TOKENS and len(known) + len(made) <= CACHE:
            known |= made
            self.tokens += len(made)
        return out


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class Writer:
    def __init__(self, stream):
        self.stream, self.table, self.index, self.size = stream, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(ids) >= 1 << 32:
            raise ValueError(f"document {doc_id} has too many ids for one frame")
        frame = self.compressor.compress(ids)
        self.stream.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.index.append((_NULL if doc_id is None else doc_id, len(ids) // 4))
        self.size += len(frame)

    def close(self) -> int:
        index = np.array(self.index, "<i8").reshape(-1, 2).tobytes()
        self.stream.write(struct.pack("<II", _INDEX, len(index)) + index)
        self.table.append((8 + len(index), 0, 0))
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), _CHECKSUMS, _FOOTER)
        self.stream.write(struct.pack("<II", _TABLE, len(table)) + table)
        self.stream.close()
        return self.size + 16 + len(index) + len(table)


class Reader:
    """Random access to one file: ``docs`` are the ids, ``counts`` the numbers of ids, ``read(i)`` the i-th document's."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.stream = store.open_input_file(path)
        size = self.stream.size()
        n, flags, magic = struct.unpack("<IBI", self.stream.read_at(9, size - 9))
        if magic != _FOOTER or flags != _CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        at = size - 9 - 12 * n
        if struct.unpack("<II", self.stream.read_at(8, at - 8)) != (_TABLE, 12 * n + 9):
            raise ValueError(f"{uri}: the seek table's header does not fit")
        self.table = np.frombuffer(self.stream.read_at(12 * n, at), "<u4").reshape(-1, 3)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        raw = self.stream.read_at(int(self.table[-1, 0]), int(self.at[-2]))
        index = np.frombuffer(raw[8:], "<i8").reshape(-1, 2)
        self.docs, self.counts = index[:, 0], index[:, 1]
        self.decompressor = zstandard.ZstdDecompressor()

    def read(self, i: int) -> bytes:
        size, raw, checksum = self.table[i].tolist()
        ids = self.decompressor.decompress(self.stream.read_at(size, int(self.at[i])), max_output_size=raw) if raw else b""
        if len(ids) != raw or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return ids

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of every row with this id; only their frames are read."""
        return [self.read(i) for i in np.flatnonzero(self.docs == doc_id).tolist()]


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, files: int | None = None) -> list[dict]:
    """Write the ids of every text in ascending doc_id order (nulls first, ties by the text's hash) and return the manifest.

    One file per range of ids: file, n_docs, n_ids, start (ids in all files before), in order. A null text counts as empty:
    it has the end id alone. Repeated rows are written again. A retried task writes a new file and only the one that
    succeeded is named, so a lost executor leaves nothing wrong in the manifest. The manifest has one entry per file.
    """
    spark = docs.sparkSession
    folder = _uri(folder or fresh_path(spark, "token-files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uri = f"{folder}/ids-{context.partitionId():06d}-{context.taskAttemptId()}.zst"
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        encode, writer, end = _encoder(vocabulary), None, struct.pack("<I", END_ID)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                writer = writer or Writer(store.open_output_stream(path, compression=None))
                writer.add(doc_id.as_py(), encode(text.as_py()) + end)
        if writer:
            size = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "file": uri, "n_docs": len(writer.index), "n_ids": sum(n for _, n in writer.index), "bytes": size}], schema=_MANIFEST)

    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange(files or parallelism(spark), F.col("doc_id").asc_nulls_first(), tie)
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    found = rows.mapInArrow(run, "part int, file string, n_docs long, n_ids long, bytes long").collect()
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        manifest.append({"file": r["file"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "bytes": r["bytes"], "start": start})
        start += r["n_ids"]
    return manifest


def read(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of the manifest, each frame checked."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch["file"], batch["start"]):
                reader = Reader(uri)
                crc = np.fromiter((zlib.crc32(reader.read(i)) for i in range(len(reader.docs))), np.int64, len(reader.docs))
                yield pd.DataFrame({
                    "doc_id": pd.array(reader.docs, "Int64").copy() if (reader.docs != _NULL).all() else pd.array([None if d == _NULL else d for d in reader.docs.tolist()], "Int64"),
                    "start": start + np.cumsum(reader.counts) - reader.counts, "n_tokens": reader.counts, "ids_crc32": crc,
                })

    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return files.repartition(len(manifest)).mapInPandas(run, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all texts' ids to a fresh folder under the shared one and read them back."""
    return read(docs.sparkSession, write(docs, vocabulary))
