import itertools
import zlib

import numpy as np
import public_tokenizers as P

from kestrel.llm.langid import identify
from kestrel.llm.lattice import Vocabulary, code_points, expected_pieces, forward, lattice
from kestrel.llm.sampled_pieces import Codec, decode, encode

MODEL = P.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if n == 1 or word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "bab"]
    rng = np.random.default_rng(0)
    weight = np.log(rng.random((len(pieces) + 1, 2)))
    words = ["abab", "b", "aabbaba", "xab", "ax", "bababab"]
    lat = lattice(code_points(words), np.array([len(w) for w in words]), Vocabulary(pieces))
    got = forward(lat, weight)[lat.last]
    number = {p: k for k, p in enumerate(pieces)}
    times = rng.random((len(words), 2))
    counts = np.zeros_like(weight)
    for i, w in enumerate(words):
        paths = [[number.get(p, len(pieces)) for p in s] for s in segmentations(w, number)]
        probs = np.array([np.exp(weight[s].sum(axis=0)) for s in paths])
        assert np.allclose(np.exp(got[i]), probs.sum(axis=0))
        for s, p in zip(paths, probs, strict=True):
            for k in s:
                counts[k] += times[i] * p / probs.sum(axis=0)
    assert np.allclose(expected_pieces(lat, weight, times), counts)


def test_language_id(docs, base_rows, no_docs):
    got = identify(docs, MODEL).collect()
    assert len(got) == len(base_rows)
    lang = {r[0]: r[2] for r in base_rows if r[0] is not None and r[0] < 1000}
    text = {r[0]: r[1] for r in base_rows}
    out = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out) > 10
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id is not None and list(t[0] for t in base_rows).count(r.doc_id) == 1:
            t = text[r.doc_id]
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, t or "")))
    assert identify(no_docs, MODEL).count() == 0


def test_language_id_without_labels(spark):
    rows = [(1, "some text", None), (2, None, None)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_sampled_pieces_are_lossless_and_reproducible(docs, base_rows, no_docs, monkeypatch):
    from kestrel.llm import sampled_pieces
    one = encode(docs, MODEL, seed=3).collect()
    two = encode(docs.repartition(11), MODEL, seed=3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.ids))
    assert sorted(map(key, one)) == sorted(map(key, two))
    other = {(r.doc_id, bytes(r.ids)) for r in encode(docs, MODEL, seed=4).collect()}
    assert len({(r.doc_id, bytes(r.ids)) for r in one} - other) > len(one) // 2
    back = decode(encode(docs, MODEL, seed=3), MODEL)
    assert back.columns == ["doc_id", "n_tokens", "text"]
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r[0] or (0 if r[0] == 0 else -1), r[1] or "") if r[0] != 0 else (-1, r[1] or "") for r in base_rows)
    assert encode(no_docs, MODEL).count() == 0


def test_sampling_follows_the_weights():
    c = Codec(MODEL, 1.0)
    n = 20_000
    got = c.encode(np.arange(n, dtype=np.uint64), ["the"] * n, [0] * n)
    number = {p: k for k, p in enumerate(c.vocab.pieces)}
    paths = {tuple(s): np.exp(sum(c.weight[number.get(p, c.vocab.size), 0] for p in s)) for s in segmentations("the", number)}
    total = sum(paths.values())
    seen = {}
    for ids in got:
        s = tuple(c.bytes_of[i].decode() for i in ids.tolist())
        seen[s] = seen.get(s, 0) + 1
    for s, p in paths.items():
        assert abs(seen.get(s, 0) / n - p / total) < 0.02
    assert list(itertools.chain([c.decode(got[0].tolist())])) == ["the"]


def test_long_text_in_parts_equals_whole(monkeypatch):
    from kestrel.llm import sampled_pieces as m
    text = " ".join(f"word{i % 97}" for i in range(3000)) + "  end "
    c = Codec(MODEL, 1.0)
    key = np.array([9], np.uint64)
    whole = c.encode(key, [text], [0])[0]
    monkeypatch.setattr(m, "BATCH_CHARS", 1000)
    parts = []
    for part, nth in m._parts(text):
        parts += c.encode(key, [part], [nth - 1 if nth else 0])[0].tolist()
    assert parts == whole.tolist()
