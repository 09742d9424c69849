"""Repeated passages removed by a distributed merge sort of suffixes with common prefixes.

A byte goes if a string of SPAN bytes covers it that also starts in a document with a smaller id.

Suffixes are sampled without loss: every SPAN-byte string has an anchor, the place of the least hash of
the HEAD-byte strings among its first REACH + 1 places, which depends on the string alone; equal strings have their
anchors at equal offsets. An anchor's context is the REACH bytes before and the SPAN bytes after it,
and holds every string whose anchor it may be.

1. Blocks of documents are stored, compressed, in the shared folder; all later steps run over them.
2. Anchors are compared by hashes of head and context. Anchors whose head occurs once need nothing more;
   of equal contexts all but those of the smallest document are repeats; the rest, different contexts with one
   head, go on (a few percent: the edges of repeated passages).
3. Each block sorts its remaining suffixes (context after the anchor, then before it, backwards) into a
   run, front-coded: length of the prefix shared with the entry before, and the rest. Runs are cut at range
   splitters and exchanged. A loser tree merges the runs of a range; entries carry the length of
   the prefix they share with the last winner, so known prefixes are never compared again, and the
   common-prefix lengths of the merged order come for free. They give the groups of suffixes that agree in 20 to 50
   bytes; within a group, agreement before the anchor completes a string, and the smallest document owns it.
4. The blocks take back, for each anchor, how far repeats reach, and cut.

A head with very many different contexts (a common line within different texts) does not go to one task: above HOT contexts its
strings are counted as rows of their own, by a plain aggregation that combines before it shuffles. Heads that a sample of blocks
shows to be that frequent are kept out of the lists from the start; the lists find the others. The sample moves work, never results.

Contexts are equal by 96 bits of hash besides the 40 of the head. Of n different contexts of one head two are taken for
equal with a probability of n^2 / 2^97: 10^-9 for 10^10 contexts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts, written

SPAN, HEAD, REACH = 50, 20, 30
BLOCK, CHUNK, PAD, HOT, SLICES = 2 << 20, 1 << 18, 64, 100_000, 6
#: Blocks that splitters and frequent heads are read from, and contexts of a head in them that make it a candidate at least.
SAMPLE, OFTEN = 16, 64
NOBODY = np.iinfo(np.int64).max  # stands for a null id: larger than any other
HEAD_BITS = 40  # a context has 96 bits: a whole 64-bit word and half of another
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S31, _S29 = np.uint64(31), np.uint64(29)

_zip = lambda x: zstandard.ZstdCompressor(level=1).compress(x)
_unzip = lambda x: zstandard.ZstdDecompressor().decompress(x)


# --- blocks ---------------------------------------------------------------------------------------

BLOCK_SCHEMA = "block long, ids binary, lengths binary, body binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def block() -> pa.RecordBatch:
        lengths = [len(t) if i is not None else -1 - len(t) for i, t in zip(ids, texts, strict=True)]  # below zero: no id
        arrays = [np.array([number]), [np.array([NOBODY if i is None else i for i in ids], "<i8").tobytes()], [_zip(np.array(lengths, "<i8").tobytes())], [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]]
        return pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int64()), *(pa.array(a, pa.binary()) for a in arrays[1:])], names=["block", "ids", "lengths", "body"])

    for b in batches:
        for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if texts and size + len(text or b"") > BLOCK:
                yield block()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(doc)
            texts.append(text or b"")
            size += len(text or b"")
    if texts:
        yield block()


class Block:
    """The texts of a block side by side, with padding that no UTF-8 text holds."""

    def __init__(self, ids: bytes, lengths: bytes, body: bytes):
        self.ids, lengths, raw = np.frombuffer(ids, "<i8"), np.frombuffer(_unzip(lengths), "<i8"), np.frombuffer(_unzip(body), np.uint8)
        self.named = lengths >= 0
        lengths = np.where(self.named, lengths, -1 - lengths)
        self.starts = np.cumsum(lengths) - lengths + PAD * np.arange(1, len(lengths) + 1)
        self.ends = self.starts + lengths
        self.data = np.full(len(raw) + PAD * (len(lengths) + 1), 0xFF, np.uint8)
        at = 0
        for s, n in zip(self.starts.tolist(), lengths.tolist(), strict=True):
            self.data[s : s + n] = raw[at : at + n]
            at += n
        self._anchors()

    def _anchors(self) -> None:
        """Anchors in order, their documents, head and context hashes; entries: one for each (head, context), sorted, with its smallest document."""
        found = []
        valid = np.zeros(len(self.data) + 1, np.int32)
        whole = self.ends - self.starts >= SPAN
        np.add.at(valid, self.starts[whole], 1)
        np.add.at(valid, self.ends[whole] - SPAN + 1, -1)
        valid = np.cumsum(valid[:-1]).astype(bool)  # places where a string of SPAN bytes starts
        for at in range(0, len(self.data), CHUNK):
            if valid[at : at + CHUNK].any():
                found.append(self._chunk(at, valid))
        places, heads, contexts, more = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3)))
        self.places, keep = np.unique(places, return_index=True)  # neighbouring chunks may find one anchor twice
        heads, contexts, more = heads[keep], contexts[keep], more[keep]
        self.doc = np.searchsorted(self.starts, self.places, "right") - 1
        owner = self.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        order = np.lexsort((owner, more, contexts, heads))
        h, c, m = heads[order], contexts[order], more[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])
        self.first = order[new]  # anchor that stands for an entry
        self.heads, self.contexts, self.more, self.owners = h[new], c[new], m[new], owner[order][new]
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.owner = owner

    def _chunk(self, at: int, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places, heads, contexts and the second half of these, of 32 bits."""
        low, high = max(0, at - REACH), min(len(self.data), at + CHUNK + REACH + SPAN + 1)
        x = self.data[low:high].astype(np.uint64)
        words = np.zeros(max(1, len(x) - 7), np.uint64)  # eight neighbouring bytes as one number
        for k in range(8 if len(x) >= 8 else 0):
            words |= x[k : len(x) - 7 + k] << np.uint64(8 * k)
        level = {1: (x + np.uint64(1)) * _M3}
        for n in (1, 2, 4, 8, 16):
            a, b = level[n][:-n], level[n][n:]
            level[2 * n] = (a ^ (a >> _S29)) * _M1 + (b ^ (b >> _S31)) * _M2
        head = (level[16][: -HEAD + 16] ^ (level[16][: -HEAD + 16] >> _S31)) * _M2 + (level[4][16:] ^ (level[4][16:] >> _S29)) * _M1
        head = (head ^ (head >> _S31)) * _M3
        n = len(head)
        bits = np.uint64(int(n).bit_length())
        least = ((head >> bits) << bits) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        own = np.flatnonzero(valid[at : at + CHUNK]) + (at - low)
        place = np.unique((least[own] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
        context, more = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        for n, offset in ((32, 0), (16, 32), (2, 48), (16, -30), (8, -14), (4, -6), (2, -2)):
            v = level[n][place + offset]
            context = (context ^ (context >> _S29)) * _M2 + (v ^ (v >> _S31)) * _M1
        # The second half comes from the bytes again, eight at a time, not from the same hashes of 32 and 16.
        for offset in (-30, -22, -14, -6, 2, 10, 18, 26, 34, 42):
            at8 = np.minimum(place + offset, len(words) - 1)
            more = (more ^ (more >> _S31)) * _M1 + (words[at8] ^ (words[at8] >> _S29)) * _M3
        return place + low, head[place] >> np.uint64(64 - HEAD_BITS), (context ^ (context >> _S31)) * _M3, ((more ^ (more >> _S29)) * _M2) >> np.uint64(32)

    def room(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the document before (REACH at most) and from (SPAN at most) each anchor."""
        p, d = self.places[anchors], self.doc[anchors]
        return np.minimum(p - self.starts[d], REACH), np.minimum(self.ends[d] - p, SPAN)

    def suffixes(self, entries: np.ndarray) -> np.ndarray:
        """Rows of SPAN bytes from the anchor and REACH bytes before it, backwards; padding beyond the document."""
        at = self.places[self.first[entries]][:, None]
        return np.concatenate([self.data[at + np.arange(SPAN)], self.data[at - 1 - np.arange(REACH)]], 1)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, list]]:
    for b in batches:
        side = b.column("side") if "side" in b.schema.names else None
        for k in range(b.num_rows):
            yield b.column("block")[k].as_py(), Block(*(b.column(c)[k].as_py() for c in ("ids", "lengths", "body"))), (side[k].as_py() or []) if side is not None else []


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# --- comparing anchors by hashes ------------------------------------------------------------------

LISTS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
STATUS = LISTS.append(pa.field("crowded", pa.bool_()))
FULL, EDGE, CROWD = 1, 2, 3  # repeats an earlier context; different contexts share its head; very many do


def _planes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def _range_of(heads: np.ndarray, n: int) -> np.ndarray:
    return ((heads >> np.uint64(HEAD_BITS - 32)) * np.uint64(n)) >> np.uint64(32)


def _frequent(b: Block, hot: np.ndarray) -> np.ndarray:
    """Entries whose head is one of the frequent ones (sorted)."""
    return np.isin(b.heads, hot) if len(hot) else np.zeros(len(b.heads), bool)


def _list_heads(n: int, hot: np.ndarray):
    def run(batches):
        for number, b, _ in _each_block(batches):
            listed = np.flatnonzero(~_frequent(b, hot))
            cuts = np.searchsorted(_range_of(b.heads[listed], n), np.arange(n + 1))
            docs, which = np.unique(b.owners, return_inverse=True)
            rows = []
            for r in range(n):
                s = listed[cuts[r] : cuts[r + 1]]
                if len(s):
                    used, k = np.unique(which[s], return_inverse=True)
                    own = docs[used]
                    head = np.array([len(k), len(own), own[0]], "<i8").tobytes() + _planes(np.diff(own, prepend=own[0]), 8)
                    rows.append((r, number, _zip(head + _planes(b.heads[s], 5) + _planes(b.contexts[s], 8) + _planes(b.more[s], 4) + _planes(k, 2 if len(own) < 1 << 16 else 4))))
            for k in range(0, len(rows), 64):
                yield _rows(LISTS, rows[k : k + 64])

    return run


def _unlist(body: bytes) -> tuple[np.ndarray, ...]:
    raw = _unzip(body)
    n, docs, least = np.frombuffer(raw, "<i8", 3).tolist()
    at = 24 + 8 * docs
    own = least + np.cumsum(_from_planes(raw[24:at], 8).astype(np.int64))
    heads, at = _from_planes(raw[at : at + 5 * n], 5), at + 5 * n
    contexts, at = _from_planes(raw[at : at + 8 * n], 8), at + 8 * n
    more, at = _from_planes(raw[at : at + 4 * n], 4), at + 4 * n
    return heads, contexts, more, own[_from_planes(raw[at:], 2 if docs < 1 << 16 else 4).astype(np.int64)]


def _by_range(batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(range, rows) of a partition sorted by range; one range is held at a time."""
    at, rows = None, []
    for b in batches:
        for r, block, body in zip(*(b.column(c).to_pylist() for c in ("range", "block", "body")), strict=True):
            if r != at and rows:
                yield at, rows
                rows = []
            at = r
            rows.append((block, body))
    if rows:
        yield at, rows


def _judge_heads(hot: int):
    def run(batches):
        """What is to be done about each anchor of the lists of a partition; a row for each list with anything to do."""
        for r, rows in _by_range(batches):
            parts_ = [_unlist(body) for _, body in rows]
            sizes = [len(x[0]) for x in parts_]
            heads, contexts, more, owners = (np.concatenate(x) for x in zip(*parts_, strict=True))
            del parts_
            order = np.argsort(heads, kind="stable")
            same = heads[order][1:] == heads[order][:-1]
            keep = np.zeros(len(heads), bool)
            keep[order[1:][same]] = True
            keep[order[:-1][same]] = True
            at = np.flatnonzero(keep)
            order = at[np.lexsort((owners[at], more[at], contexts[at], heads[at]))]
            h, c, m, d = heads[order], contexts[order], more[order], owners[order]
            status = np.zeros(len(heads), np.uint8)
            if len(order):
                new_h = np.r_[True, h[1:] != h[:-1]]
                new_c = new_h | np.r_[True, (c[1:] != c[:-1]) | (m[1:] != m[:-1])]
                group = np.cumsum(new_h) - 1
                least = d[new_c][np.cumsum(new_c) - 1]
                classes = np.bincount(group[new_c])[group]
                first, last = np.minimum.reduceat(d, np.flatnonzero(new_h))[group], np.maximum.reduceat(d, np.flatnonzero(new_h))[group]
                out = np.where(d > least, FULL, np.where((classes > 1) & (first < last), np.where(classes > hot, CROWD, EDGE), 0))
                status[order] = out
            at = 0
            out_rows = []
            for (block, _), n in zip(rows, sizes, strict=True):
                s = status[at : at + n]
                at += n
                if s.any():
                    out_rows.append((r, block, _zip(s.tobytes()), bool((s == CROWD).any())))
            for k in range(0, len(out_rows), 256):
                yield _rows(STATUS, out_rows[k : k + 256])

    return run


def _statuses(b: Block, side: list, n: int, hot: np.ndarray) -> np.ndarray:
    often = _frequent(b, hot)
    listed = np.flatnonzero(~often)
    cuts = np.searchsorted(_range_of(b.heads[listed], n), np.arange(n + 1))
    out = np.where(often, np.uint8(CROWD), np.uint8(0))
    for x in side:
        if x["kind"] == 0:
            out[listed[cuts[x["range"]] : cuts[x["range"] + 1]]] = np.frombuffer(_unzip(x["body"]), np.uint8)
    return out


# --- sorted runs and their merge ------------------------------------------------------------------


def _sorted(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{SPAN + REACH}").ravel() if not (rows == 0).any() else np.array([x.tobytes() for x in rows], object), kind="stable")


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Lengths of the prefixes that sorted rows share with the row before, and the rests of the rows, joined."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def front_decode(shared: list[int], rest: bytes) -> Iterator[tuple[bytes, int]]:
    at, before, width = 0, b"", SPAN + REACH
    for k in shared:
        before = before[:k] + rest[at : at + width - k]
        at += width - k
        yield before, k


class LoserTree:
    """Merges sorted streams of (string, length of the prefix shared with the stream's string before).

    A node holds the loser of its match with the length of the prefix it shares with the winner. Two
    contestants both know what they share with the last string put out: the longer share wins
    unseen; only equal shares are compared, from there on.
    """

    def __init__(self, streams: list[Iterator[tuple[bytes, int]]]):
        self.streams, n = streams, len(streams)
        self.size = 1 << max(0, n - 1).bit_length()
        self.text: list[bytes | None] = [None] * self.size
        self.share = [0] * self.size
        for k, s in enumerate(streams):
            first = next(s, None)
            self.text[k] = first[0] if first else None
        self.node = [0] * self.size
        winners = list(range(self.size))
        level = self.size
        while level > 1:
            level //= 2
            won = []
            for k in range(level):
                w, loser = self._match(winners[2 * k], winners[2 * k + 1])
                self.node[level + k] = loser
                won.append(w)
            winners = won
        self.winner = winners[0]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        s, t = self.share[a], self.share[b]
        if s != t:
            return (a, b) if s > t else (b, a)
        n = len(x)
        while s < n and x[s] == y[s]:
            s += 1
        if s == n or x[s] < y[s]:
            self.share[b] = s
            return a, b
        self.share[a] = s
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(stream, string, length shared with the string before) in order."""
        while (text := self.text[w := self.winner]) is not None:
            yield w, text, self.share[w]
            after = next(self.streams[w], None)
            self.text[w], self.share[w] = after if after else (None, 0)
            k = (w + self.size) // 2
            while k:
                w, self.node[k] = self._match(min(w, self.node[k]), max(w, self.node[k]))  # equal strings: first stream first
                k //= 2
            self.winner = w


RUNS = LISTS


def _cut_runs(n: int, hot: np.ndarray, splitters: list[bytes]):
    def run(batches):
        for number, b, side in _each_block(batches):
            entries = np.flatnonzero(_statuses(b, side, n, hot) == EDGE)
            if not len(entries):
                continue
            rows = b.suffixes(entries)
            order = _sorted(rows)
            rows, entries = rows[order], entries[order]
            heads = [bytes(x) for x in rows[:, :HEAD]]
            which = np.array([bisect_right(splitters, h) for h in heads])
            out = []
            for r in np.unique(which).tolist():
                s = which == r
                shared, rest = front_code(rows[s])
                out.append((r, number, _zip(np.array([s.sum()], "<i8").tobytes() + shared.astype(np.uint8).tobytes() + _planes(entries[s], 4) + b.owners[entries[s]].astype("<i8").tobytes() + rest)))
            for k in range(0, len(out), 64):
                yield _rows(RUNS, out[k : k + 64])

    return run


def reaches(rows: np.ndarray, shared: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far repeats of smaller documents reach before and from each of the sorted suffixes; zeros for none."""
    before, after = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
    right = np.where((rows[:, :SPAN] == 0xFF).any(1), (rows[:, :SPAN] == 0xFF).argmax(1), SPAN)
    left = np.where((rows[:, SPAN:] == 0xFF).any(1), (rows[:, SPAN:] == 0xFF).argmax(1), REACH)
    shared = np.minimum(shared, SPAN)
    known = np.zeros(len(rows), np.uint64)
    for o in range(REACH + 1):
        if o:
            known = (known ^ (known >> _S31)) * _M2 + (rows[:, SPAN + o - 1].astype(np.uint64) + np.uint64(1)) * _M3
        group = np.cumsum(shared < SPAN - o)
        at = np.flatnonzero((right >= SPAN - o) & (left >= o))
        order = at[np.lexsort((owners[at], known[at], group[at]))]
        if not len(order):
            continue
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | (known[order][1:] != known[order][:-1])]
        hit = order[owners[order] > owners[order][new][np.cumsum(new) - 1]]
        before[hit] = np.maximum(before[hit], o)
        after[hit] = np.maximum(after[hit], SPAN - o)
    return before, after


def _merge_runs(batches):
    for r, found in _by_range(batches):
        streams, entries, owners = [], [], []
        for _, body in found:
            raw = _unzip(body)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            streams.append(front_decode(list(raw[8 : 8 + n]), raw[8 + 13 * n :]))
            entries.append(_from_planes(raw[8 + n : 8 + 5 * n], 4).astype(np.int64))
            owners.append(np.frombuffer(raw, "<i8", n, 8 + 5 * n))
        source, texts, shared = [], [], []
        for w, text, k in LoserTree(streams):
            source.append(w)
            texts.append(text)
            shared.append(k)
        source = np.array(source)
        order = np.argsort(source, kind="stable")  # a stream's entries come out in its own order
        owner = np.empty(len(source), np.int64)
        owner[order] = np.concatenate(owners)
        before, after = reaches(np.frombuffer(b"".join(texts), np.uint8).reshape(-1, SPAN + REACH), np.array(shared), owner)
        back_before, back_after = before[order], after[order]
        at, out = 0, []
        for (block, _), e in zip(found, entries, strict=True):
            x, y = back_before[at : at + len(e)], back_after[at : at + len(e)]
            at += len(e)
            hit = y > 0
            if hit.any():
                out.append((r, block, _zip(e[hit].astype("<i8").tobytes() + x[hit].tobytes() + y[hit].tobytes())))
        for k in range(0, len(out), 256):
            yield _rows(RUNS, out[k : k + 256])


def _sample_heads(batches):
    """Heads as bytes, at even steps, and as numbers with their contexts, of those that have several in a block."""
    schema = pa.schema([("head", pa.binary()), ("number", pa.int64()), ("n", pa.int64())])
    for _, b, _ in _each_block(batches):
        some = b.suffixes(np.arange(0, len(b.heads), max(1, len(b.heads) // 2000)))[:, :HEAD]
        heads, n = np.unique(b.heads, return_counts=True)
        heads, n = heads[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([*(bytes(x) for x in some), *[None] * len(heads)], pa.binary()), pa.array([*[None] * len(some), *heads.tolist()], pa.int64()), pa.array([*[0] * len(some), *n.tolist()], pa.int64())], schema=schema)


# --- heads with very many contexts: strings as rows -----------------------------------------------


def _crowd_strings(n: int, hot: np.ndarray):
    """block, entry, before, key, owner of every string of the anchors whose heads are crowded."""
    schema = pa.schema([("block", pa.int64()), ("entry", pa.int64()), ("before", pa.int32()), ("key", pa.binary()), ("owner", pa.int64())])

    def run(batches):
        for number, b, side in _each_block(batches):
            entries = np.flatnonzero(_statuses(b, side, n, hot) == CROWD)
            left, right = b.room(b.first[entries])
            for o in range(REACH + 1):
                at = np.flatnonzero((left >= o) & (right >= SPAN - o))
                places = b.places[b.first[entries[at]]] - o
                for k in range(0, len(at), 4096):
                    raw = b.data[places[k : k + 4096, None] + np.arange(SPAN)]
                    e = entries[at[k : k + 4096]]
                    if len(e):
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(e)), pa.array(e), pa.array([o] * len(e), pa.int32()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in raw], pa.binary()), pa.array(b.owners[e])], schema=schema)

    return run


def _crowd_reaches(batches):
    """Packs block, entry, before, after of a partition into side rows."""
    schema = LISTS
    for b in batches:
        block, entry, before, after = (c.to_numpy() for c in b.columns)
        for k in np.unique(block).tolist():
            s = block == k
            yield _rows(schema, [(-1, k, _zip(entry[s].astype("<i8").tobytes() + before[s].astype(np.uint8).tobytes() + after[s].astype(np.uint8).tobytes()))])


# --- cutting --------------------------------------------------------------------------------------

RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def covered(b: Block, side: list, n: int, hot: np.ndarray) -> np.ndarray:
    """Bytes of the block's data that go."""
    status = _statuses(b, side, n, hot)
    before, after = np.zeros(len(b.heads), np.int64), np.zeros(len(b.heads), np.int64)
    for x in side:
        if x["kind"] == 1:
            raw = _unzip(x["body"])
            k = len(raw) // 10
            e = np.frombuffer(raw, "<i8", k)
            before[e] = np.maximum(before[e], np.frombuffer(raw, np.uint8, k, 8 * k))
            after[e] = np.maximum(after[e], np.frombuffer(raw, np.uint8, k, 9 * k))
    left, right = b.room(np.arange(len(b.places)))
    repeat = (status[b.entry] == FULL) | (b.owner > b.owners[b.entry])
    repeat &= left + right >= SPAN
    x, y = np.where(repeat, left, before[b.entry]), np.where(repeat, right, after[b.entry])
    hit = y > 0
    change = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(change, b.places[hit] - x[hit], 1)
    np.add.at(change, b.places[hit] + y[hit], -1)
    return np.cumsum(change[:-1]) > 0


def _cut(n: int, hot: np.ndarray):
    def run(batches):
        for _, b, side in _each_block(batches):
            gone = covered(b, side, n, hot)
            rows = []
            for doc, named, s, e in zip(b.ids.tolist(), b.named.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True):
                g = gone[s:e]
                lost = int(g.sum())
                kept = b.data[s:e][~g] if lost else b.data[s:e]
                rows.append((doc if named else None, e - s, lost, int((g[1:] & ~g[:-1]).sum()) + int(g[:1].sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
            yield _rows(RESULT, rows)

    return run


def _cut_texts(n: int, hot: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def run(batches):
        for _, b, side in _each_block(batches):
            gone = covered(b, side, n, hot)
            yield _rows(schema, [(doc if named else None, b.data[s:e][~gone[s:e]].tobytes()) for doc, named, s, e in zip(b.ids.tolist(), b.named.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True)])

    return run


def _with_side(blocks: DataFrame, *sides: tuple[int, DataFrame]) -> DataFrame:
    """blocks with what was found about each, as an array of (kind, range, body)."""
    rows = None
    for kind, df in sides:
        here = df.select("block", F.struct(F.lit(kind).alias("kind"), "range", "body").alias("x"))
        rows = here if rows is None else rows.union(here)
    side = rows.groupBy("block").agg(F.collect_list("x").alias("side"))
    return blocks.join(side, "block", "left")


def _plan(docs: DataFrame, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, int, np.ndarray]:
    spark = docs.sparkSession
    tasks = parts(spark)
    n = SLICES * tasks  # ranges of heads; a task judges its ranges one after the other
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    blocks = written(source.mapInArrow(_to_blocks, BLOCK_SCHEMA), "suffix-blocks")
    # Splitters need only be roughly even, and not every frequent head must be known: both come from SAMPLE blocks.
    some = [r.block for r in blocks.select("block").orderBy(F.hash("block")).limit(SAMPLE).collect()]  # numbers alone, not bodies
    sample = written(blocks.where(F.col("block").isin(some)).mapInArrow(_sample_heads, "head binary, number long, n long"), "suffix-sample")
    heads = sorted(bytes(r["head"]) for r in sample.where("head is not null").select("head").collect())  # 2,000 a block
    splitters = sorted({heads[k * len(heads) // tasks] for k in range(1, tasks)}) if heads else []
    least = max(min(OFTEN, hot), hot * len(some) / max(1, blocks.count()))
    often = np.array(sorted(r.number for r in sample.where("number is not null").groupBy("number").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("number").collect()), np.uint64)
    kind = "range int, block long, body binary"
    dealt = lambda df, a_task: df.repartitionById(tasks, F.floor(F.col("range") / a_task).cast("int")).sortWithinPartitions("range")
    lists = blocks.mapInArrow(_list_heads(n, often), kind)
    status = written(dealt(lists, SLICES).mapInArrow(_judge_heads(hot), kind + ", crowded boolean"), "suffix-status")
    judged = _with_side(blocks, (0, status))
    found = written(dealt(judged.mapInArrow(_cut_runs(n, often, splitters), kind), 1).mapInArrow(_merge_runs, kind), "suffix-reaches")
    crowded = status.where("crowded").select("block").distinct()
    if not len(often) and crowded.isEmpty():
        return _with_side(blocks, (0, status), (1, found)), n, often
    held = judged if len(often) else judged.join(crowded, "block", "left_semi")
    strings = held.mapInArrow(_crowd_strings(n, often), "block long, entry long, before int, key binary, owner long")
    strings = written(strings, "suffix-crowds")
    least = written(strings.groupBy("key").agg(F.min("owner").alias("least")), "suffix-owners")
    crowds = strings.join(least, "key").where(F.col("owner") > F.col("least"))
    crowds = crowds.groupBy("block", "entry").agg(F.max("before").alias("before"), (F.lit(SPAN) - F.min("before")).alias("after"))
    crowds = written(crowds.mapInArrow(_crowd_reaches, kind), "suffix-crowd-reaches")
    return _with_side(blocks, (0, status), (1, found), (1, crowds)), n, often


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, text (UTF-8 bytes that are left) of every row; cuts may fall within a character."""
    blocks, n, often = _plan(docs, id_col, text_col, hot)
    return blocks.mapInArrow(_cut_texts(n, often), "doc_id long, text binary")


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text counts as empty; texts under SPAN bytes lose nothing. Rows with the same id do not count
    as earlier for each other; a null id is later than any other. Other columns are ignored; an empty
    table gives none.
    """
    blocks, n, often = _plan(docs, id_col, text_col, hot)
    return blocks.mapInArrow(_cut(n, often), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
