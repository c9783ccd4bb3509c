import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from kestrel.llm.binary_ids import read_ids, work_folder, write_ids
from kestrel.llm.packing import pack, plan_slots
from kestrel.llm import text_tokens
from kestrel.llm.text_tokens import Encoder, encode_each


def reference(name):
    t = Tokenizer.from_file(P.path(name))  # as the library encodes: added tokens in a text are themselves
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_encoding_equals_whole_text_encoding(name, base_rows, monkeypatch):
    monkeypatch.setattr(text_tokens, "SEGMENT_CHARS", 5000)
    monkeypatch.setattr(text_tokens, "MEMO_MAX", 3000)
    enc, want = Encoder(P.path(name)), reference(name)
    assert enc.kind in ("word", "byte")
    texts = [r[1] for r in base_rows] + ["don't we'll I'M x'S", "a<|endoftext|>b", "a <|endoftext|> b\n<|endoftext|>", "<|EndOfText|>x <|startoftext|>", " <|endoftext|>\n\nc", "<|endoftext", "İstanbul ΣΑΣ ß", "\x1c a \x85b", " lead", "trail \n", "a\n\nb \n c  d", "½ ² x_y 10,000.5"]
    for text, ids in zip(texts, encode_each(enc, texts), strict=True):
        assert ids.tolist() == want(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_chunk_that_repeats_is_looked_up_once_a_batch(name):
    class Memo(dict):
        asked = 0

        def get(self, *a):
            Memo.asked += 1
            return super().get(*a)

    enc, want = Encoder(P.path(name)), reference(name)
    enc.memo = Memo()
    texts = ["one two, two\ntwo one two"] * 50
    assert [x.tolist() for x in encode_each(enc, texts)] == [want(t) for t in texts]
    assert Memo.asked <= 5  # "one" at a start, " two,", " two", "\ntwo", " one"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_cut_beside_any_white_space(name, monkeypatch):
    monkeypatch.setattr(text_tokens, "SEGMENT_CHARS", 60)
    monkeypatch.setattr(text_tokens, "BATCH_CHARS", 500)
    rnd = random.Random(7)
    bits = ["", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000",
            "a", "B", "word", "Wort", "don't", "'S", "12", ".", "\x00", "\x7f", "ÿ", "é", "×", "Ā", "“", "—", "、", "中", "Σ", "İ", "e\u0301", "\U0001F600", "\ufeff", "\ufffd"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    want = reference(name)
    for text, ids in zip(texts, encode_each(Encoder(P.path(name)), texts), strict=True):
        assert ids.tolist() == want(text), repr(text)
    for text in texts[:300]:
        chunks, first = text_tokens.chunked(["x", text])
        assert [c.lstrip(b"\xff").decode() for c in chunks.to_pylist()[first[1]:]] == text_tokens.CUT.split(text)


def test_plan_is_gapless_and_tight():
    rnd = random.Random(2)
    hist = Counter(min(100, int(rnd.expovariate(0.05)) + 1) for _ in range(5000))
    hist[100] += 700
    fill, ranks = Counter(), Counter()
    places = {}
    for length, first, n, per, seq, off in plan_slots(dict(hist), 100):
        assert ranks[length] == first
        ranks[length] += n
        for i in range(n):
            s, o = seq + i // per, off + i % per * length
            places.setdefault(s, []).append((o, length))
            fill[s] += length
    assert ranks == hist and max(fill.values()) <= 100
    for own in places.values():
        at = 0
        for o, length in sorted(own):
            assert o == at
            at += length
    total = sum(k * v for k, v in hist.items())
    assert len(fill) <= 1.02 * total / 100 + 1


def test_packing(docs, base_rows, no_docs):
    want = reference("word_bpe_49k.json")
    got = pack(docs, P.path("word_bpe_49k.json"), 0, digest=True).collect()
    pieces = Counter()
    for r in base_rows:
        ids = np.array([*want(r[1]), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            p = ids[at:at + 2048]
            pieces[(r[0], k, at, len(p), zlib.crc32(p.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, length in sorted(own):
            assert o == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert pack(no_docs, P.path("word_bpe_49k.json"), 0).count() == 0


def test_packing_returns_ids(docs):
    rows = pack(docs.limit(20), P.path("word_bpe_49k.json"), 0).collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_token_files_round_trip(spark, docs, base_rows, no_docs):
    want = reference("byte_bpe_50k.json")
    folder = work_folder(spark, "test")
    write_ids(docs, folder, P.path("byte_bpe_50k.json"), 2)
    got = sorted(read_ids(spark, folder).collect(), key=lambda r: r.start)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    start = 0
    ordered = sorted(base_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert key(ordered[0])[0] is False and len(got) == len(ordered)
    for r, row in zip(got, ordered, strict=True):
        ids = [*want(row[1]), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (row[0], start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    folder = work_folder(spark, "test")
    write_ids(no_docs, folder, P.path("byte_bpe_50k.json"), 2)
    assert read_ids(spark, folder).count() == 0
