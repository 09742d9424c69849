import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from quire.llm import pieces, tokenfiles
from quire.llm.queries import TOKENIZERS

from .conftest import pairs

PIECES, WORDS = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/word_bpe_49k.json"
ODD = ["a", "b", "th", "the ", "  ", "\n", " ", "é", "漢", "😀", "▁", "\t", "<s>", "<0x0A>", "́", "ing", "Q", "7", ".", "...", "\x00", "​", "ß", "don't", "<|endoftext|>", "\xa0", "İ", "Σ", "é", "The,", "A?", "<|", "É."]


def odd_texts(n):
    rng = random.Random(9)
    return ["", " ", "\n", "▁▁", "a" * 400, "the cat" * 60] + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        c = pieces.PieceCodec(f.read())
    texts = odd_texts(800)
    for t, (ids, decimal) in zip(texts, c.encode_batch(texts), strict=True):
        want = sp.encode(t)
        assert ids.tolist() == want and decimal == "".join(f"{i}," for i in want)
        assert c.decode(ids) == sp.decode(want).encode()


def test_rounds_equal_the_heap():
    with open(PIECES, "rb") as f:
        c = pieces.PieceCodec(f.read())
    words = [w for t in odd_texts(200) for w in c.split(t)]
    assert c._rounds(words) == [c._heap(w) for w in words]


def test_piece_digest(hard, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t in pairs(hard):
        ids = sp.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, pieces.digest(hard, PIECES).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.digest(empty, PIECES).count() == 0
    assert {(r.doc_id, r.decoded) for r in pieces.encode(hard, PIECES).collect()} == {(d, t or "") for d, t in pairs(hard)}


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    enc, tok = tokenfiles.ChunkEncoder(spec), Tokenizer.from_str(spec)
    assert enc.direct
    texts = odd_texts(1500)
    for t, raw in zip(texts, enc.batch(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_frames_are_read_alone_and_checked():
    import zstandard

    out = io.BytesIO()
    w = tokenfiles.FrameWriter(out, 2)
    docs = [(5, [1, 2, 3]), (None, []), (9, list(range(1000)))]
    for d, ids in docs:
        raw = np.array(ids, "<u2").tobytes()
        w.add(d, zstandard.ZstdCompressor(write_content_size=True).compress(raw), len(raw), tokenfiles._checksum(raw))
    w.close()
    r = tokenfiles.FrameReader(io.BytesIO(out.getvalue()))
    assert r.docs == [5, None, 9] and [r.ids(k).tolist() for k in (2, 0, 1)] == [docs[2][1], [1, 2, 3], []]
    # Any decoder of the format reads the file as one stream; the seek table is skipped.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole.startswith(np.array([1, 2, 3], "<u2").tobytes())
    broken = bytearray(out.getvalue())
    broken[int(r.starts[2]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfiles.FrameReader(io.BytesIO(bytes(broken))).ids(2)


def test_token_files(hard, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = sorted(map(tuple, tokenfiles.token_file_digest(hard, WORDS).collect()), key=lambda r: r[1])
    want = sorted(((d is not None, d or 0), [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in pairs(hard))
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in rows) == sorted((*d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    assert [(r[0] is not None, r[0] or 0) for r in rows] == [d for d, _ in want]  # in ascending order
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:])) and rows[0][1] == 0
    assert tokenfiles.token_file_digest(empty, WORDS).count() == 0
