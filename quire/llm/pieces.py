"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by table gathers.

No piece of a BPE vocabulary holds the space mark after another character, so a text falls into words
(a run of marks and the characters up to the next) that never merge with each other. The distinct
words of a batch are encoded together, those of like length in one numpy table (a column a word): in
each round the least pair rank of every word (leftmost first), all those merges at once, and only the
two pairs beside each merge looked up anew; columns without a pair left drop out. One merge a word and
round keeps the library's order exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released

MARK = "▁"
#: Words up to CACHED characters are remembered, WORDS of them at most; from LONG characters on, a word is merged with a heap, whose cost does not grow with its square.
CACHED, WORDS, LONG = 48, 100_000, 256
#: Widths of the tables of words and cells of a table; bits for a place in a word, the rank of what is no pair, and the factor that spreads pairs over their hash table.
_WIDTHS, _CELLS = np.array([*range(2, 15), 16, 18, 20, 24, 32, 48, 64, 96, 128, 192, LONG, 512, 1024, 2047]), 1 << 18
_BITS, _NONE, _SPREAD = 11, 1 << 30, np.uint64(0x9E3779B97F4A7C15)


class PieceCodec:
    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.size = sp.get_piece_size()
        ids = range(n)
        self.unk = sp.unk_id()
        byte_of = {i: int(sp.id_to_piece(i)[3:5], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in byte_of.items()}
        self.normal = {sp.id_to_piece(i): i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = {p: sp.get_score(i) for p, i in self.normal.items()}
        if len(self.normal) >= _NONE >> _BITS:
            raise ValueError("too many pieces")
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.stop = n + 0x110000  # symbols: piece ids, then n + code point for characters that are no piece, then the end of a word
        self.base = self.stop + 1
        self.of_char = np.arange(n, self.stop, dtype=np.int64)
        for p, i in self.normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda p: self.normal.get(p, n + ord(p) if len(p) == 1 else None)
        pairs = {}
        for p, i in self.normal.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (order[scores[p]], i)
        self.pairs = pairs
        # Open addressing; an empty slot is where a search for no pair ends, so it has that rank.
        bits = max(4, (8 * len(pairs) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        for key, (rank, i) in pairs.items():
            at = (key * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while self.keys[at] >= 0:
                at = (at + 1) & self.last
            self.keys[at], self.rank[at], self.merged[at] = key, rank << _BITS, i
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            self.words = re.compile("(?s).+")
        elif any("\n" in p for p in self.normal):
            self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.words = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        out = [b"" if sp.is_control(i) else bytes([byte_of[i]]) if i in byte_of else " ⁇ ".encode() if i == self.unk else sp.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.length = np.array([len(x) for x in out], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.numbers = [f"{i}," for i in ids]
        self.digits = np.array([len(x) for x in self.numbers], np.int64)
        self.of_byte = np.array([self.byte_id.get(b, self.unk) for b in range(256)], np.int32)
        self.ids: dict[str, bytes] = {}
        self.decimal: dict[str, str] = {}

    def _finish(self, symbols: list[int]) -> list[int]:
        if max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in chr(s - self.size).encode())
            else:
                out.append(self.unk)
        return out

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair of symbols; an empty one for what is no pair."""
        key = left.astype(np.int64) * self.base + right
        at = (key.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)
        got = self.keys[at]
        lost = np.flatnonzero((got != key) & (got >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & self.last
            got = self.keys[at[lost]]
            lost = lost[(got != key[lost]) & (got >= 0)]
        return at

    def _table(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of one word a column after all merges; places that are merged away or beyond a word hold the end."""
        out, which = symbols, np.arange(symbols.shape[1])
        rows, width = symbols.shape
        row = np.arange(rows, dtype=np.int32)[:, None]
        slot = np.zeros(symbols.shape, np.int32)
        slot[:-1] = self._find(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(rows - 1, width)
        best = self.rank[slot] | row  # rank first, then place
        best[-1] = _NONE
        after = np.broadcast_to(row + 1, symbols.shape).copy()
        before = np.broadcast_to(row - 1, symbols.shape).copy()
        before[0] = rows - 1  # the last row holds ends alone
        while True:
            least = best.min(axis=0)
            col = np.flatnonzero(least < _NONE)
            if 4 * len(col) < 3 * width:
                if symbols is not out:
                    out[:, which] = symbols
                if not len(col):
                    return out
                which, least, width = which[col], least[col], len(col)
                symbols, slot, best, after, before = (np.ascontiguousarray(x[:, col]) for x in (symbols, slot, best, after, before))
                col = np.arange(width)
            s, x, b, n, p = (t.reshape(-1) for t in (symbols, slot, best, after, before))  # views
            place = least[col] & ((1 << _BITS) - 1)
            at = place * width + col
            gone = n[at] * width + col
            following, left = n[gone], p[at]
            right_at, left_at = following * width + col, left * width + col
            new = self.merged[x[at]]
            s[at], s[gone], b[gone], n[at], p[right_at] = new, self.stop, _NONE, following, place
            found = self._find(np.concatenate([s[left_at], new]), np.concatenate([new, s[right_at]]))
            ranks, k = self.rank[found], len(col)
            x[left_at], x[at] = found[:k], found[k:]
            b[left_at], b[at] = ranks[:k] | left, ranks[k:] | place

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (none is empty, none has over 2,047 characters) one after the other, and where each word's begin, with their end."""
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int32)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        size = np.searchsorted(_WIDTHS, lengths)
        for g in np.unique(size).tolist():
            mine = np.flatnonzero(size == g)
            step = _CELLS // int(_WIDTHS[g])
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                row = np.arange(_WIDTHS[g] + 1)[:, None]
                inside = row < lengths[part]
                at = np.where(inside, starts[part] + row, 0)
                done = self._table(np.where(inside, symbols[at], np.int32(self.stop)))
                symbols[at[inside]] = done[inside]
        kept = symbols != self.stop
        counts = np.add.reduceat(kept, starts, dtype=np.int64)
        ids = symbols[kept]
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):
            chars = ids[odd] - self.size
            n = (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)) if self.byte_id else np.ones(len(odd), np.int64)
            raw = np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)
            times = np.ones(len(ids), np.int64)
            times[odd] = n
            which = np.repeat(np.arange(len(words)), counts)
            counts = counts + np.bincount(which[odd], n - 1, len(words)).astype(np.int64)
            ids = np.repeat(ids, times)
            ids[ids >= self.size] = self.of_byte[raw] if self.byte_id else self.unk
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _rounds(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, as `_merged` takes them."""
        ids, ends = self._merged(words)
        return [x.tolist() for x in np.split(ids, ends[1:-1])]

    def _heap(self, word: str) -> list[int]:
        symbols = self.of_char[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (found := self.pairs.get(symbols[a] * self.base + symbols[b])):
                heapq.heappush(queue, (found[0], a, symbols[a], symbols[b]))

        for a in range(n):
            offer(a)
        while queue:
            _, a, left, right = heapq.heappop(queue)
            b = after[a]
            if symbols[a] != left or b >= n or symbols[b] != right:
                continue
            symbols[a] = self.pairs[left * self.base + right][1]
            symbols[b] = -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return self._finish([s for s in symbols if s >= 0])

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Remembers the ids of new short words; returns those of the other new words."""
        if len(self.ids) + len(words) > WORDS:
            self.forget()
        rest_ids: dict[str, bytes] = {}
        rest_decimal: dict[str, str] = {}
        short: list[str] = []
        for w in words - self.ids.keys():
            if len(w) < LONG:
                short.append(w)
            else:
                x = self._heap(w)
                rest_ids[w], rest_decimal[w] = array("i", x).tobytes(), "".join(map(self.numbers.__getitem__, x))
        if short:
            ids, ends = self._merged(short)
            raw, decimal = ids.astype("i4").tobytes(), "".join(map(self.numbers.__getitem__, ids.tolist()))
            digits = np.concatenate([[0], np.cumsum(self.digits[ids])])[ends].tolist()
            ends = (4 * ends).tolist()
            for w, a, b, c, d in zip(short, ends, ends[1:], digits, digits[1:]):
                if len(w) <= CACHED:
                    self.ids[w], self.decimal[w] = raw[a:b], decimal[c:d]
                else:
                    rest_ids[w], rest_decimal[w] = raw[a:b], decimal[c:d]
        return rest_ids, rest_decimal

    def forget(self) -> None:
        self.ids.clear()
        self.decimal.clear()

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, and the same as decimal numbers each with a comma after it."""
        split = [self.split(t) for t in texts]
        rest_ids, rest_decimal = self.learn(set().union(*split))
        for words in split:
            try:
                raw, decimal = b"".join(map(self.ids.__getitem__, words)), "".join(map(self.decimal.__getitem__, words))
            except KeyError:
                raw = b"".join([self.ids.get(w) or rest_ids[w] for w in words])
                decimal = "".join([self.decimal.get(w) or rest_decimal[w] for w in words])
            yield np.frombuffer(raw, "i4"), decimal

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the mark of the first piece goes, other marks are spaces, byte pieces are bytes."""
        done = []
        for k in range(0, len(ids), 1 << 18):
            x = ids[k : k + (1 << 18)]
            n = self.length[x]
            at = np.repeat(self.start[x] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            done.append(self.flat[at].tobytes())
        out = b"".join(done)
        out = out[1:] if out[:1] == b" " and len(ids) and ids[0] != self.unk else out
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


_CODEC: dict[bytes, PieceCodec] = {}


def codec(proto: bytes) -> PieceCodec:
    """One codec a worker process, with the words it remembers."""
    key = hashlib.sha256(proto).digest()
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = PieceCodec(proto)
    return _CODEC[key]


def _texts(b: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in b.column("text").to_pylist()]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _shipped(docs: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, not data


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and decoded string of every row.

    Null text counts as empty: no ids, empty decoding. Repeated rows each give a row; other columns
    are ignored; an empty table gives an empty result.
    """
    proto = _shipped(docs, model_path)

    def run(batches):
        c = codec(proto.value)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                ids = [i for i, _ in c.encode_batch(_texts(s))]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i).decode() for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what `encode` gives for every row (same cases)."""
    proto = _shipped(docs, model_path)

    def run(batches):
        c = codec(proto.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                out = [(len(i), sha(d[:-1].encode()), sha(c.decode(i))) for i, d in c.encode_batch(_texts(s))]
                n, ids, decoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()  # the worker may do other work next

    return _source(docs, id_col, text_col).mapInArrow(lambda batches: released(run(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
