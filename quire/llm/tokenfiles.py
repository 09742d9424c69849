"""Token-ID files in the seekable Zstandard format: one independent frame a document, then a frame that
lists the documents, then the seek table (sizes and a checksum of every frame) as a skippable frame.

A reader fetches the table from the end of the file and decompresses only the frames it wants.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_dir, parts, written

#: Magic numbers of the seekable format; bit 7 of the descriptor: checksums present.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Chunks up to CACHED characters are remembered, CHUNKS of them at most.
CACHED, CHUNKS = 48, 800_000
#: Texts whose chunks are encoded together: few, so that their words are still in the processor's cache when they are looked up again.
TOGETHER = 16


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes compressed frames to a stream; close() adds the document list and the seek table."""

    def __init__(self, out: BinaryIO, width: int):
        self.out, self.width, self.table, self.docs = out, width, [], []

    def add(self, doc: int | None, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.table.append((len(frame), size, checksum))
        self.docs.append(doc)

    def close(self) -> None:
        known = np.array([d is not None for d in self.docs], np.uint8).tobytes()
        index = struct.pack("<BI", self.width, len(self.docs)) + np.array([d or 0 for d in self.docs], "<i8").tobytes() + known
        self.add(None, zstandard.ZstdCompressor(level=3).compress(index), len(index), _checksum(index))
        body = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Random access to the documents of one file object with seek() and read()."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file")
        source.seek(end - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.table, self.starts = table, np.cumsum(table[:, 0]) - table[:, 0]
        index = self._frame(n - 1)
        self.width, count = struct.unpack_from("<BI", index)
        ids, known = np.frombuffer(index, "<i8", count, 5), np.frombuffer(index, np.uint8, count, 5 + 8 * count)
        self.docs = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]

    def _frame(self, k: int) -> bytes:
        size, length, checksum = self.table[k].tolist()
        self.source.seek(int(self.starts[k]))
        data = self.unzip.decompress(self.source.read(size), max_output_size=length) if length else b""
        if len(data) != length or _checksum(data) != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, k: int) -> np.ndarray:
        """Token ids of the k-th document, as 32-bit numbers."""
        return np.frombuffer(self._frame(k), f"<u{self.width}").astype("<u4")


class ChunkEncoder:
    """The library's ids of whole texts, put together from the ids of their chunks between spaces and line feeds.

    Normaliser, pre-tokeniser and added tokens of this vocabulary never reach across those two
    characters, so a text's ids are its chunks' ids in order; a chunk is encoded by the library once.
    A run of letters below U+0100, perhaps with ASCII punctuation after it, needs no normaliser but
    lower case and is one pre-token (and all the punctuation another): such words go straight to the library's BPE model.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.model = self.tok.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = str.maketrans({b: chr(256 + k) for k, b in enumerate(others)})
        probes = ["the", "Na\u00efve", "Stra\u00dfe,", "\u00e9t\u00e9.", "Idea!", "x", "it'", "a<|##"]
        self.known: dict[str, bytes] = {"": b""}
        self.direct = True
        self._learn(probes)
        self.direct = [self.known[p] for p in probes] == self._whole(probes)
        self.known = {"": b""}

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Remembers the ids of short new chunks; returns those of the others."""
        known, tokenize, kind = self.known, self.model.tokenize, self.kind
        rest: dict[str, bytes] = {}
        odd = []
        for chunk in chunks:
            stem = chunk.rstrip(string.punctuation)
            if not (self.direct and stem.isalpha() and (stem.isascii() or max(stem) <= "\u00ff")):
                odd.append(chunk)
                continue
            word = stem.lower()
            raw = known.get(word)
            if raw is None:
                written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                raw = array(kind, [t.id for t in tokenize(written)]).tobytes()
                if len(word) <= CACHED:
                    known[word] = raw
            if len(stem) < len(chunk):
                tail = chunk[len(stem) :]
                mark = known.get(tail)
                if mark is None:
                    mark = self._whole([tail])[0]
                    if len(tail) <= CACHED:
                        known[tail] = mark
                raw += mark
            (known if len(chunk) <= CACHED else rest)[chunk] = raw
        for k in range(0, len(odd), 1024):
            for chunk, raw in zip(odd[k : k + 1024], self._whole(odd[k : k + 1024]), strict=True):
                (known if len(chunk) <= CACHED else rest)[chunk] = raw
        return rest

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        for some in itertools.batched(texts, TOGETHER):
            split = [t.replace("\n", " ").split(" ") for t in some]
            if len(self.known) > CHUNKS:
                self.known = {"": b""}
            rest = self._learn(set().union(*split).difference(self.known))
            for words in split:
                try:
                    yield b"".join(map(self.known.__getitem__, words))
                except KeyError:
                    yield b"".join([rest[c] if c in rest else self.known[c] for c in words])


_ENCODER: dict[str, ChunkEncoder] = {}


def encoder(spec: str) -> ChunkEncoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = ChunkEncoder(spec)
    return _ENCODER[key]


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes the ids of every row, in ascending order of id, to files below out_dir, a folder all machines reach.

    Returns (uri, documents, ids) of the files in order, a line for each range partition. A repeated
    task writes a new file; only files of tasks that ended are listed. Null text counts as empty (the
    end id alone), null ids come first, equal ids are ordered by their frames.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, not data

    def compress(batches):
        enc = encoder(spec.value)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        zip_ = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                s = b.slice(k, 1024)
                raw = [x + end for x in enc.batch((t or b"").decode("utf-8", "replace") for t in s.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array([zip_.compress(x) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([_checksum(x) for x in raw], pa.int64()), pa.array([enc.width] * len(raw), pa.int32())],
                    names=["doc_id", "frame", "size", "checksum", "width"],
                )

    def write(batches):
        from pyspark import TaskContext

        part, writer = TaskContext.get().partitionId(), None
        uri = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        fs, path = _open(uri)
        tokens = 0
        for b in batches:
            for doc, frame, size, checksum, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    fs.create_dir(path.rpartition("/")[0])
                    stream = fs.open_output_stream(path + ".part")
                    writer = FrameWriter(stream, width)
                writer.add(doc, frame, size, checksum)
                tokens += size // width
        if writer is not None:
            docs_here = len(writer.docs)
            writer.close()
            stream.close()
            fs.move(path + ".part", path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([docs_here], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "uri", "docs", "tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    frames = written(source.mapInArrow(compress, "doc_id long, frame binary, size long, checksum long, width int"), "token-frames")
    ordered = frames.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "frame")
    files = written(ordered.mapInArrow(write, "part long, uri string, docs long, tokens long"), "token-manifest")
    return [(r.uri, r.docs, r.tokens) for r in files.orderBy("part").collect()]  # one line per partition


def read_tokens(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    base, rows = 0, []
    for uri, _, tokens in files:
        rows.append((uri, base))
        base += tokens

    def read(batches):
        for b in batches:
            for uri, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    reader, out = FrameReader(f), []
                    for k, doc in enumerate(reader.docs):
                        ids = reader.ids(k)
                        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                for k in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out[k : k + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    at = spark.createDataFrame(rows, "uri string, start long")
    return at.repartition(max(1, min(len(rows), parts(spark)))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the token files of `docs` to the shared folder and describes what is read back from them. Other columns are ignored."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer_path, new_dir(spark, "tokens")))
