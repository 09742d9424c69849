"""ISO base media containers: a writer of raw-sample tracks and a reader that never decodes payloads.

The reader walks nested boxes, decodes the sample tables (stsd, stts, stss, stsz, stsc, stco or co64)
and gives codec, duration and the byte ranges of keyframes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: A frame is 8 x 8 pixels of three 8-bit samples; every 12th frame is a sync sample; a chunk holds 16 frames.
FRAME, SIDE, GROUP, CHUNK, TIMESCALE = 192, 8, 12, 16, 24
#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"))
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *body: bytes) -> bytes:
    n = 8 + sum(map(len, body))
    return b"".join((struct.pack(">I4s", n, kind), *body))


def _full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def pad(data: bytes) -> bytes:
    """data with spaces appended up to a positive multiple of the frame size."""
    return data + b" " * ((-len(data)) % FRAME or (0 if data else FRAME))


def pack(payload: bytes) -> bytes:
    """A movie with one raw RGB track whose frames are the payload, in order. No times of day, so equal payloads give equal files."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else ([(1, CHUNK, 1)] if chunks > 1 else []) + [(chunks, n % CHUNK, 1)]
    keys = range(1, n + 1, GROUP)

    def movie(offset: int) -> bytes:
        entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 24, -1))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *range(offset, offset + chunks * CHUNK * FRAME, CHUNK * FRAME))),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 16, _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(head) + len(movie(0)) + 16  # mdat has a 64-bit size
    return b"".join((head, movie(start), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)), payload))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes in a range; 64-bit sizes and 'to the end' (0) included."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("truncated box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit its parent")
        yield kind, body, start + size
        start += size


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of the body) of all boxes, parents first, however deep they are nested."""
    open_ = [((), boxes(data, start, end))]
    while open_:
        path, rest = open_[-1]
        found = next(rest, None)
        if found is None:
            open_.pop()
            continue
        kind, a, b = found
        yield (*path[:3], kind), a, b  # deeper levels are told by their last kinds alone
        if kind in CONTAINERS:
            open_.append(((*path[:3], kind), boxes(data, a, b)))


def _u32(data: memoryview, at: int, n: int, wide: bool = False) -> np.ndarray:
    return np.frombuffer(data, ">u8" if wide else ">u4", n, at).astype(np.int64)


def _entries(data: memoryview, at: int, end: int, width: int, wide: bool = False) -> np.ndarray:
    """The numbers of a table of entries of `width` bytes, whose count must fit its box."""
    if end - at < 8:
        raise ValueError("truncated table")
    n = struct.unpack_from(">I", data, at + 4)[0]
    if n > (end - at - 8) // width:
        raise ValueError("a table counts more entries than its box holds")
    return _u32(data, at + 8, n if wide else n * width // 4, wide)


def _track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> dict:
    """Decodes one track's tables into sample offsets and sizes."""
    at = found[b"mdhd"][0]
    timescale, = struct.unpack_from(">I", data, at + (20 if data[at] else 12))
    duration, = struct.unpack_from(">Q" if data[at] else ">I", data, at + (24 if data[at] else 16))
    codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
    table = lambda kind, width: _entries(data, *found[kind], width, kind == b"co64")
    at, end = found[b"stsz"]
    if end - at < 12:
        raise ValueError("truncated sample sizes")
    size, n = struct.unpack_from(">II", data, at + 4)
    if n > (len(data) // size if size else (end - at - 12) // 4):
        raise ValueError("more samples than the file can hold")
    sizes = np.full(n, size, np.int64) if size else _u32(data, at + 12, n)
    offsets = table(b"co64", 8) if b"co64" in found else table(b"stco", 4)
    runs = table(b"stsc", 12).reshape(-1, 3)
    chunks = np.diff(np.append(runs[:, 0], len(offsets) + 1))
    if len(offsets) and (not len(runs) or runs[0, 0] != 1) or (chunks < 0).any() or int((runs[:, 1] * chunks).sum()) != n:
        raise ValueError("sample tables disagree")
    per = np.repeat(runs[:, 1], chunks)
    chunk = np.repeat(np.arange(len(offsets)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    starts = offsets[chunk] + before - before[np.minimum(first, n - 1)][chunk] if n else sizes
    if n and (starts.min() < 0 or (starts + sizes).max() > len(data)):
        raise ValueError("samples outside the file")
    keys = table(b"stss", 4) - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("sync samples that are not there")
    times = table(b"stts", 8).reshape(-1, 2)
    return {"codec": codec, "timescale": timescale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": keys}


def inspect(content: bytes) -> list[dict]:
    """The tracks of a container. Payload bytes are not touched."""
    data, tracks = memoryview(content), []
    for path, a, b in walk(data, 0, len(data)):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif len(path) > 2 and path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (a, b))
    return [_track(data, t) for t in tracks]


def read_samples(content: bytes, track: dict) -> bytes:
    """The samples' bytes in order; neighbouring ranges are read as one."""
    starts, ends = track["starts"], track["starts"] + track["sizes"]
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut - 1, len(starts) - 1]
    return b"".join(content[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)) if len(starts) else b""


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            s = b.slice(k, 512)
            raw = [x or b"" for x in s.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([pack(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and `media`, the container of the padded UTF-8 text (null: empty). One row per input row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(_pack_batches, "doc_id long, n_bytes long, media binary")


COLUMNS = "codec string, duration double, n_samples long, keyframes array<struct<start:long,size:long>>, error string"


def media_columns(df: DataFrame, content_col: str = "media") -> DataFrame:
    """Adds codec, duration (seconds), n_samples, keyframes and error, of the first track, as one struct column `media_info`.

    A null, empty or damaged container gives nulls and a message in `error`; other columns, whatever
    their names, stay as they are (a column `media_info` is replaced).
    """

    def describe(content: bytes | None) -> dict:
        try:
            t = inspect(content or b"")[0]
            keys = t["keys"]
            return {"codec": t["codec"], "duration": t["duration"] / t["timescale"] if t["timescale"] else None, "n_samples": len(t["sizes"]), "keyframes": [{"start": a, "size": n} for a, n in zip(t["starts"][keys].tolist(), t["sizes"][keys].tolist(), strict=True)], "error": None}
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return {"codec": None, "duration": None, "n_samples": None, "keyframes": None, "error": f"{type(e).__name__}: {e}"}

    kind = pa.struct([("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in COLUMNS.split(', '))}>")
    def info(content: pa.Array) -> pa.Array:
        return pa.array([describe(x) for x in content.to_pylist()], kind)

    return df.withColumn("media_info", info(F.col(content_col)))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        out = []
        for doc, n, media in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            (t,) = inspect(media)
            payload, keys = read_samples(media, t), t["keys"]
            ranges = np.stack([t["starts"][keys], t["sizes"][keys]], 1)
            feature = f"{t['codec'].strip()};{t['duration']}/{t['timescale']}s;{len(t['sizes'])} samples;{len(keys)} keyframes;{ranges[0, 0]}+{ranges[0, 1]}..{ranges[-1, 0]}+{ranges[-1, 1]};ranges {zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
            out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as a container in a table, reads the table back and describes what was read.

    Null text counts as empty (one frame of spaces); repeated rows each give a row; an empty table
    gives none; other columns are ignored.
    """
    stored = written(pack_texts(docs), "media")
    return stored.mapInArrow(_digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
