import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import media, sharding

from .conftest import pairs


def least_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = 1, max(1, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 24, 70])
def test_shards_are_the_smallest_possible(hard, shards):
    rows = sharding.shard(hard, shards).collect()
    docs = pairs(hard)
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    groups = defaultdict(int)
    for _, t in docs:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += size(t)
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert max(loads.values()) == least_capacity([groups[k] for k in sorted(groups)], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_coarse_index_is_refined_to_the_exact_answer():
    rng = random.Random(1)
    for _ in range(40):
        sizes = [rng.choice([1, 3, 9, 200]) + rng.randint(0, 30) for _ in range(rng.randint(1, 80))]
        cuts, total = [], 0
        for s in sizes:
            cuts.append(total)
            total += s

        def cells(windows, width):
            got = defaultdict(list)
            for c in cuts:
                for lo, hi in windows:
                    if lo <= c <= hi:
                        got[lo, (c - lo) // width(lo, hi)].append(c)
            return [(min(x), max(x)) for x in got.values()]

        k = rng.randint(1, 9)
        index = sharding.CutIndex(total)
        index.load(cells([(0, total)], lambda lo, hi: max(1, total // 3)), set())
        for _ in range(200):
            found = index.cuts(k)
            if not index.open:
                break
            index.load(cells(sorted(index.open), lambda lo, hi: max(1, -(-(hi - lo + 1) // 3))), set(index.open))
        ends = [0, *found, total]
        assert set(found) <= set(cuts) and len(found) < k
        assert max(b - a for a, b in zip(ends, ends[1:])) == least_capacity(sizes, k)


def test_empty_tables(empty):
    assert sharding.shard(empty, 24).count() == 0 and media.media_digest(empty).count() == 0


def test_media_round_trip(hard):
    rows = media.media_digest(hard).collect()
    want = Counter()
    for d, t in pairs(hard):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(len({x[1:] for x in g}) == 1 for g in _by(rows, lambda r: r.payload_sha256 + str(r.n_bytes), lambda r: (r.doc_id, r.media_bytes, r.media_sha256, r.feature)))


def _by(rows, key, value):
    out = defaultdict(set)
    for r in rows:
        out[key(r)].add(value(r))
    return out.values()


@pytest.mark.parametrize("frames", [1, 11, 12, 13, 16, 17, 32, 100])
def test_container_tables(frames):
    payload = bytes(range(192)) * frames
    (t,) = media.inspect(media.pack(payload))
    assert (t["codec"], t["duration"], t["timescale"], t["ticks"], len(t["sizes"])) == ("raw ", frames, 24, frames, frames)
    content = media.pack(payload)
    assert media.read_samples(content, t) == payload
    assert t["keys"].tolist() == list(range(0, frames, 12))
    assert all(content[a : a + 192] == bytes(range(192)) for a in t["starts"][t["keys"]].tolist())


def test_damaged_containers(spark):
    good = media.pack(bytes(192))
    df = spark.createDataFrame([(bytearray(good),), (bytearray(good[:300]),), (None,), (bytearray(b""),)], "media binary")
    got = [r.media_info for r in media.media_columns(df).collect()]
    assert got[0].codec == "raw " and got[0].duration == 1 / 24 and got[0].error is None
    assert all(x.codec is None and x.error for x in got[1:])
