"""Byte-level BPE vocabulary files, exact splitting into chunks and pre-tokens, and encoding by distinct chunks."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from gridstone.llm import common

# The published pre-token pattern of byte-level BPE, for ASCII and the letters of U+00C0 to U+024F.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_LATIN = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
# UTF-8 of the white space beyond ASCII (Unicode's White_Space).
WIDE_WHITE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_LEADS = np.zeros(256, bool)
_LEADS[sorted({w[0] for w in WIDE_WHITE})] = True
#: Bytes of a pre-token from which merging goes by a heap.
_LONG = 256


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file: merges by rank, ids by bytes, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pre, model = data["pre_tokenizer"] or {}, data["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or data["normalizer"]:
            raise ValueError("a plain byte-level BPE file is needed")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda token: bytes(back[c] for c in token)
        added = data.get("added_tokens") or []
        self.specials = {t["content"]: t["id"] for t in added}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special tokens with options are not supported")
        self.ids = {raw(token): i for token, i in model["vocab"].items() if token not in self.specials}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        self._byte_ids = [self.ids.get(bytes([b])) for b in range(256)]
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        longest_first = sorted(self.specials, key=len, reverse=True)
        if any(c.isspace() for content in self.specials for c in content):
            raise ValueError("special tokens that hold white space are not supported")
        self._special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def _split(self, text: str) -> list[str]:
        if text.isascii() or _LATIN.fullmatch(text):
            return LATIN_PRE_TOKEN.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel  # its Unicode tables decide what a letter or a number is

        pre = per_process("pre-tokenizer", lambda: ByteLevel(add_prefix_space=False, use_regex=True))
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order; joined they are the text."""
        if self._special is None or not any(s in text for s in self.specials):
            return self._split(text)
        out, at = [], 0
        for found in self._special.finditer(text):
            out += self._split(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self._split(text[at:])

    def encode(self, text: str) -> list[int]:
        """Ids of a text, every pre-token merged anew."""
        return [i for w in self.parts(text) for i in ([self.specials[w]] if w in self.specials else self.merge(w.encode()))]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked, leftmost pair is merged until none is left."""
        if len(word) > _LONG:
            return self._merge_long(word)
        ids = [self._byte_ids[b] for b in word]
        rank, merged, none = self.ranks.get, self.merged, len(self.merged)
        waiting = [rank(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while waiting and (best := min(waiting)) < none:
            i = waiting.index(best)
            ids[i : i + 2] = [merged[best]]
            del waiting[i]
            if i:
                waiting[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(waiting):
                waiting[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same by a heap over a linked list, n log n for very long words."""
        ids: list[int | None] = [self._byte_ids[b] for b in word]
        end, rank = len(ids), self.ranks.get
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(end - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[best], None
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [i for i in ids if i is not None]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Memo:
    """Remembers at most ``most`` keys, in two generations: keys in use move on when the older half is dropped."""

    def __init__(self, most: int) -> None:
        self.half = most // 2
        self.now: dict = {}
        self._before: dict = {}

    def unknown(self, keys: list) -> list[int]:
        """Places of the keys to look up anew; all others are in ``now`` after this."""
        if len(self.now) > self.half:
            self._before, self.now = self.now, {}
        now, before = self.now, self._before
        out = []
        for i, k in enumerate(keys):
            if k not in now:
                if (found := before.get(k)) is None:
                    out.append(i)
                else:
                    now[k] = found
        return out


def _white(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = common.SPACES[buf]
    at = np.flatnonzero(_LEADS[buf])
    if len(at):
        padded = np.concatenate([buf, np.zeros(2, np.uint8)])
        found = padded[at].astype(np.uint32) << 16 | padded[at + 1].astype(np.uint32) << 8 | padded[at + 2]
        for w in WIDE_WHITE:
            code = int.from_bytes(w, "big") << 8 * (3 - len(w))
            hits = at[(found if len(w) == 3 else found & np.uint32(0xFFFF00)) == code]
            for i in range(len(w)):
                white[hits + i] = True
    return white


@dataclass
class Chunked:
    """Texts as numbers of distinct chunks. A chunk begins where a text does and where white space begins.

    Outside of white space no pre-token goes on across such a place, and within white space the pattern looks
    at the next character alone, which is in the same chunk; so the pre-tokens of a text are those of its chunks in order.

    buf: bytes of all texts. keys: 64-bit hashes of the distinct chunks. start, end: where the first of each stands.
    number: which one each chunk is. cuts: n + 1 offsets of the texts into ``number``.
    """

    buf: np.ndarray
    keys: np.ndarray
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    cuts: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Chunked:
        buf, offsets = common.text_buffer(column)
        n = len(buf)
        if not n:
            none = np.zeros(0, np.int64)
            return cls(buf, none.astype(np.uint64), none, none, none, np.zeros(len(offsets), np.int64), offsets)
        white = _white(buf)
        begins = white.copy()
        begins[1:] &= ~white[:-1]
        begins[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        number, keys = pd.factorize(common.hash_spans(buf, start, end))
        first = np.empty(len(keys), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        return cls(buf, keys, start[first], end[first], number, np.searchsorted(start, offsets), offsets)

    def raw(self, i: int) -> bytes:
        """The i-th distinct chunk."""
        return self.buf[self.start[i] : self.end[i]].tobytes()


def gather(flat: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat`` (side by side, of these sizes) in the order of ``number``, and n + 1 offsets of them."""
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    size = sizes[number]
    at = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(begins[number] - at[:-1], size) + np.arange(at[-1])], at


_LOADED: dict = {}


def per_process(key: object, make: Callable[[], object]) -> object:
    """One object for each key in this Python process, made when first asked for."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def latest_per_process(kind: str, key: object, make: Callable[[], object]) -> object:
    """As ``per_process``, but only the last object of a kind is kept: workers go from operator to operator, and the kind
    ``heavy`` is for what an operator need not hold once another one runs."""
    held = _LOADED.get(kind)
    if held is None or held[0] != key:
        _LOADED.pop(kind, None)
        _LOADED[kind] = held = key, make()
    return held[1]
