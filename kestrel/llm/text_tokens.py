"""Whole-text encoding with public tokenizer files, fast enough for a corpus.

The tokenizers' own pre-tokenisation never joins text across a single space or
line feed between two visible characters, so a text can be cut there, and the
ids of a text are the ids of its chunks in order.  Chunks repeat; a bounded
memo per Python worker encodes each only once, and a batch is put together
with array operations.  Chunks of plain Latin letters, digits and punctuation
go through the tokenizer's model piece by piece; every other chunk goes
through its full ``encode_batch``.  A tokenizer of an unknown kind encodes
whole texts.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import types
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The pre-tokenisation of the two vocabularies, for Latin-1 text (fixed values).
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+"
PLAIN_CHUNK = r"[ \n]?[!-~À-ÿ]+"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
MEMO_MAX = 700_000          # entries of a worker's memo; it starts anew beyond
SEGMENT_CHARS = 1_000_000   # longer texts are encoded segment by segment
BATCH_CHARS = 2_000_000     # texts encoded together
TOKEN_ID = attrgetter("id")
START = b"\xff"             # before a text's first chunk: no byte of UTF-8
SPACE, LINE_FEED = 32, 10
SHOWN = np.array([not chr(i).isspace() if i < 0x80 else i < 0xFF for i in range(256)])  # a byte that ASCII white space or START is not
WHITE_2, WHITE_3 = (np.array([int.from_bytes(chr(i).encode(), "big") for i in r if chr(i).isspace()], np.int32)
                    for r in (range(0x80, 0x800), range(0x800, 0xD800)))


def worker_state(name: str) -> dict:
    """A dict that lives as long as this Python process (tasks reuse workers)."""
    mod = sys.modules.setdefault("_kestrel_worker_state", types.ModuleType("_kestrel_worker_state"))
    return mod.__dict__.setdefault(name, {})


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's visible stand-in for each byte: itself if printable,
    else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def chunked(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The chunks of all texts, as CUT cuts them, in UTF-8, and the number of
    each text's first chunk.  A chunk begins with the space or line feed it
    was cut at, a text's first chunk with START."""
    data = [t.encode() for t in texts]
    joined = START + START.join(data) + 4 * START
    size = np.fromiter(map(len, data), np.int64, len(data)) + 1
    first, total = np.cumsum(size) - size, int(size.sum())
    b = np.frombuffer(joined, np.uint8)
    at = np.flatnonzero((b[:total] == SPACE) | (b[:total] == LINE_FEED))
    at = at[SHOWN[b[at - 1]] & SHOWN[b[at + 1]]]
    wide = (b[at - 1] >= 0x80) | (b[at + 1] >= 0x80)
    if wide.any():  # white space of two or three bytes
        p = at[wide]
        before, after = ((b[p + i].astype(np.int32) << 16) + (b[p + i + 1].astype(np.int32) << 8) + b[p + i + 2] for i in (-3, 1))
        white = np.isin(before, WHITE_3) | np.isin(before & 0xFFFF, WHITE_2) | np.isin(after, WHITE_3) | np.isin(after >> 8, WHITE_2)
        wide[wide] = white
        at = at[~wide]
    begins = np.zeros(total + 1, bool)
    begins[at] = begins[first] = begins[total] = True
    offsets = np.flatnonzero(begins)
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return chunks, np.searchsorted(offsets, first)


class Encoder:
    """``encode(texts)``: all ids, and the number of ids of each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]  # found in a text by the library
        self.kind = self._kind(spec)
        self.pieces = re.compile(BYTE_PIECES if self.kind == "byte" else WORD_PIECES)
        self.plain = re.compile(PLAIN_CHUNK)
        self.alphabet = byte_alphabet()
        self.model = self.tok.model
        self._clear()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        if model["type"] != "BPE" or model.get("dropout"):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "byte"
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert"):
            return "word"
        return "whole"

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.of_piece: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)  # a chunk's ids in flat
        self.piece_at, self.piece_size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _hold(self, name: str, at: int, values) -> None:
        """Write values into one of the arrays, which grows as needed."""
        a = getattr(self, name)
        while len(a) < at + len(values):
            a = np.resize(a, 2 * len(a))
        a[at:at + len(values)] = values
        setattr(self, name, a)

    def _hold_ids(self, ids, size: np.ndarray, name: str, n: int) -> None:
        """Append ids, ``size`` of them for every entry from number ``n`` on."""
        self._hold("flat", self.used, ids)
        self._hold(f"{name}at", n, self.used + np.cumsum(size) - size)
        self._hold(f"{name}size", n, size)
        self.used += len(ids)

    def _gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(at - (ends - size), size)]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers; new ones go through the tokenizer's model."""
        got = np.fromiter(map(self.of_piece.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(got < 0)
        if missing.size:
            absent = [pieces[i] for i in missing]
            new, n = list(dict.fromkeys(absent)), len(self.of_piece)
            ascii_only = [p for p in new if p.isascii()]  # of these only a leading space or line feed looks different
            wide = [p for p in new if not p.isascii()]
            shown = "\t".join(ascii_only).replace(" ", self.alphabet[SPACE]).replace("\n", self.alphabet[LINE_FEED]).split("\t") if ascii_only else []
            shown += [p.encode().decode("latin-1").translate(self.alphabet) for p in wide]
            tokens = list(map(self.model.tokenize, shown))
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            self._hold_ids(np.fromiter(map(TOKEN_ID, chain.from_iterable(tokens)), np.uint32, int(size.sum())), size, "piece_", n)
            self.of_piece.update(zip(chain(ascii_only, wide), range(n, n + len(new))))
            got[missing] = np.fromiter(map(self.of_piece.__getitem__, absent), np.int64, len(absent))
        return got

    def _learn(self, keys: list[bytes]) -> None:
        """Encode chunks and append them to the memo."""
        lower, split, plain = self.kind == "word", self.pieces.findall, self.plain.fullmatch
        every = b"".join(keys).replace(START, b" ").decode().lower()
        added = [a for a in self.added if a in every]  # in any of these chunks
        letters = not any(a.isalpha() for a in added)
        single, mixed, odd, texts, odd_texts = [], [], [], [], []
        for k in keys:
            if letters and k[0] == SPACE and k[1:].isalpha():  # one piece
                single.append(k)
                continue
            text = k[1:].decode() if k[0] == START[0] else k.decode()
            if not plain(text) or (added and any(a in text.lower() for a in added)):
                odd.append(k)
                odd_texts.append(text)
            else:
                mixed.append(k)
                texts.append(text.lower() if lower else text)
        words = b"".join(single).decode()
        pieces = words.lower().split() if lower else words.replace(" ", "\t ").split("\t")[1:]
        found = [split(t) for t in texts]
        number = self._numbers([*pieces, *chain.from_iterable(found)])
        n, own, rest = len(self.memo), number[:len(single)], number[len(single):]
        self._hold("at", n, self.piece_at[own])
        self._hold("size", n, self.piece_size[own])
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        size = self.piece_size[rest]
        self._hold_ids(self._gather(self.piece_at[rest], size), np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]), "", n + len(single))
        if odd:
            got = [e.ids for e in self.tok.encode_batch(odd_texts, add_special_tokens=False)]
            self._hold_ids(list(chain.from_iterable(got)), np.fromiter(map(len, got), np.int64, len(got)), "", n + len(single) + len(mixed))
        self.memo.update(zip(chain(single, mixed, odd), range(n, n + len(keys))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.kind == "whole":
            got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(g) for g in got], np.int64)
        if len(self.memo) > MEMO_MAX:
            self._clear()
        chunks, first = chunked(texts)
        chunks = chunks.dictionary_encode()  # a chunk that repeats in the batch is looked up once
        at, blob = np.frombuffer(chunks.dictionary.buffers()[1], np.int64), chunks.dictionary.buffers()[2].to_pybytes()
        keys = [blob[i:j] for i, j in pairwise(at[:len(chunks.dictionary) + 1].tolist())]
        own = np.fromiter(map(self.memo.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(own < 0)
        if missing.size:
            absent = [keys[i] for i in missing]
            collecting = gc.isenabled()
            gc.disable()  # nothing made there is cyclic, and the memo is large to walk
            try:
                self._learn(absent)
            finally:
                if collecting:
                    gc.enable()
            own[missing] = np.fromiter(map(self.memo.__getitem__, absent), np.int64, len(absent))
        idx = own[chunks.indices.to_numpy()]
        size = self.size[idx]
        per_text = np.diff(np.concatenate([[0], np.cumsum(size)])[[*first, len(idx)]])
        return self._gather(self.at[idx], size), per_text


def encoder(path: str) -> Encoder:
    kept = worker_state("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def segments(text: str) -> Iterator[str]:
    """A long text in parts whose ids, in order, are the text's ids."""
    at = 0
    while len(text) - at > SEGMENT_CHARS and (m := CUT.search(text, at + SEGMENT_CHARS)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def encode_each(enc: Encoder, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The ids of every text, in order; null counts as empty.  Texts are
    encoded together up to BATCH_CHARS, longer ones in segments."""
    waiting: list[str] = []
    chars = 0

    def flush() -> Iterator[np.ndarray]:
        ids, sizes = enc.encode(waiting)
        return iter(np.split(ids, np.cumsum(sizes)[:-1]))

    for text in texts:
        text = text or ""
        if len(text) > SEGMENT_CHARS and enc.kind != "whole":
            if waiting:
                yield from flush()
                waiting, chars = [], 0
            yield np.concatenate([enc.encode([s])[0] for s in segments(text)])
            continue
        waiting.append(text)
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield from flush()
            waiting, chars = [], 0
    if waiting:
        yield from flush()
