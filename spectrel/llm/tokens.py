"""Token ids of whole texts, with a cache of pre-tokens.

The tokenizers library splits a text into pre-tokens and encodes each on its own. Most pre-tokens recur, so a worker
keeps their ids and hands only new ones to the library (byte-level ones to its model, as they are split already). The texts of a slice are split together, by
comparing neighbouring characters' classes, and pre-tokens are looked up by a 64-bit hash and their ends. Texts with
characters outside the plain set below, or with the text of a special token, go to the library whole. The ids equal those
of ``Tokenizer.encode(text, add_special_tokens=False)`` in every case. Two kinds of vocabularies are cached so: byte-level
ones whose pre-tokens take a blank before them, and lower-case ones that drop white space and mark the ends of words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

from .common import BASE, BASE_INVERSE, mixed, powers

#: Characters for which Python's character classes and the tokenizer's agree.
_PLAIN = r"\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ɏ‐-‧€"
_ODD = re.compile(f"[^{_PLAIN}]")
#: Where a long text may be cut: a run of white space starts a pre-token whatever comes before.
_CUT = re.compile(r"(?<=[^\s])\s")
#: Characters split at a time, about.
CHUNK = 1 << 17
#: Pre-tokens kept by a worker; beyond that those not met again since go. Longer ones than LONGEST characters aren't kept.
CACHE = 800_000
LONGEST = 64
JOINED = 256

#: Fixed values of the lower-case vocabulary: how it splits texts, and what ends a word.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"

#: The character by which a byte-level vocabulary writes each byte, in the order of bytes.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = [chr(b if b in _PRINTABLE else 256 + b - sum(x < b for x in _PRINTABLE)) for b in range(256)]
_TO_CHARS = str.maketrans(dict(enumerate(_BYTE_CHARS)))

_END, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)
#: Plain characters beyond the Latin blocks are moved next to these.
_LATIN, _POINTS, _EURO = 0x250, 0x2010, 0x20AC
_EURO_AT = _LATIN + 0x18
_BITS = 21


def _classes() -> np.ndarray:
    out = np.zeros(_EURO_AT + 1, np.uint8)
    for i in range(1, len(out)):
        c = "€" if i == _EURO_AT else chr(i if i < _LATIN else i - _LATIN + _POINTS)
        kind = unicodedata.category(c)[0]
        out[i] = _SPACE if c in "\t\n\r " else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return out


_CLASS = _classes()
_VALUE = np.random.default_rng(20250131).integers(1, 2**63, len(_CLASS), dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the hash base and of its inverse, as many as were asked for so far."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1), powers(BASE_INVERSE, 1)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(BASE_INVERSE, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def split(text: str, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of plain texts joined by \\0: where each begins, its hash, and its ends and length in one number.

    A pre-token is a run of letters, numbers or other signs with at most one blank before it, a short form such as 's, or a
    run of white space less the last one before anything else. A \\0 is one of its own. With ``words``, white space is no
    part of any, and a number is a pre-token of its own.
    """
    u = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
    if u.max(initial=0) >= _LATIN:
        u = np.where(u < _LATIN, u, np.where(u == _EURO, _EURO_AT, u - (_POINTS - _LATIN)))
    n = len(u)
    kind = _CLASS[u]
    begins = np.empty(n, bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[kind == _END] = True
    if words:
        begins[kind == _NUMBER] = True
    else:
        # the last white space before a sign starts a pre-token, and if it is a blank, the sign goes with it
        before = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] > _SPACE))
        begins[before] = True
        begins[before[u[before] == 32] + 1] = False
    # short forms, where the apostrophe itself starts a pre-token
    at = np.flatnonzero(u == 39)
    at = at[begins[at]]
    if len(at):
        one, two = u[np.minimum(at + 1, n - 1)], u[np.minimum(at + 2, n - 1)]
        single = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        begins[at[single | double] + 1] = False
        begins[at[single] + 2] = True
        begins[at[double] + 3] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    if words:
        there = kind[start] != _SPACE
        start, end = start[there], end[there]
    with np.errstate(over="ignore"):
        up, down = _POWERS(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[u] * up, out=total[1:])
        size = end - start
        h = mixed((total[end] - total[start]) * down[start] + size.astype(np.uint64))
    return start, h, (size << 32) | (u[start].astype(np.int64) << 16) | u[end - 1]


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        model = spec.get("model", {})
        self.cached = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        self.words = self._drops_space(spec.get("normalizer") or {}, pre, model)
        vocab = self.tokenizer.get_vocab()
        # ids that start a pre-token with a blank, or end a word
        self.marks = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            if token.endswith(_WORD_END) if self.words else token[:1] == "Ġ":
                self.marks[i] = True
        self.limit = cache
        self._clear()

    @staticmethod
    def _drops_space(normalizer: dict, pre: dict, model: dict) -> bool:
        """Whether this is a lower-case vocabulary with ends of words, split by WORD_PATTERN."""
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normalizer.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
            return False
        cut, level = parts
        plain = cut["pattern"] == {"Regex": WORD_PATTERN} and cut["behavior"] == "Removed" and cut["invert"] and not level["use_regex"] and not level["add_prefix_space"]
        return bool(plain and model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == _WORD_END)

    def _plain(self, text: str) -> str | None:
        """The text to split here, or None if the library has to take it whole."""
        if not (self.cached or self.words) or any(s in text for s in self.special):
            return None
        if text.isascii() and text.isprintable():
            return text.lower() if self.words else text
        if _ODD.search(text):
            return None
        if not self.words:
            return text
        text = text.lower()
        return None if _ODD.search(text) else text

    def _clear(self) -> None:
        # an open hash table: the entry at each slot (-1: none); entries hold hash, ends, and where their ids are
        self.slots = np.full(1 << _BITS, -1, np.int32)
        self.hashes, self.ends, self.again = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.starts, self.sizes, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.known = self.filled = 0

    def _make_room(self) -> None:
        """Drop the pre-tokens that weren't met again since they came or were last sorted out; all, if that leaves too many."""
        stay = np.flatnonzero(self.again[: self.known])
        h, ends, starts, sizes, ids = self.hashes[stay], self.ends[stay], self.starts[stay], self.sizes[stay].astype(np.int64), self.ids
        self._clear()
        if 2 * len(stay) <= self.limit:
            self._keep(h, ends, sizes, spread(ids, starts.astype(np.int64), sizes), list(range(len(stay))))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _look_up(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each pre-token, -1 if there is none."""
        mask = len(self.slots) - 1
        at = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & ((self.hashes[found] != h) | (self.ends[found] != ends)))
        step = at[wrong]
        while len(wrong):
            step = (step + 1) & mask
            entry = self.slots[step]
            found[wrong] = entry
            still = (entry >= 0) & ((self.hashes[entry] != h[wrong]) | (self.ends[entry] != ends[wrong]))
            wrong, step = wrong[still], step[still]
        return found

    def _insert(self, first: int, h: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        entry = np.arange(first, first + len(h), dtype=np.int32)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            left = self.slots[at] != entry
            entry, at = entry[left], (at[left] + 1) & mask

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Numbers of ids of pre-tokens, all ids, and the pre-tokens' order in these."""
        if not self.words:
            # pre-tokens go to the library's model as they are, written in its characters; none holds \0
            model = self.tokenizer.model.tokenize
            found = [[t.id for t in model(w)] for w in "\0".join(new).encode().decode("latin-1").translate(_TO_CHARS).split(_BYTE_CHARS[0])]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), list(range(len(new)))
        sizes = np.zeros(len(new), np.int64)
        flats, order = [], []
        chunks = [list(range(i, min(i + JOINED, len(new)))) for i in range(0, len(new), JOINED)]
        for chunk, ids in zip(chunks, self._whole([" ".join([new[i] for i in c]) for c in chunks])):
            ids = np.asarray(ids, np.uint32)
            cuts = np.flatnonzero(self.marks[ids])
            if len(cuts) == len(chunk) and cuts[-1] == len(ids) - 1:
                sizes[chunk] = np.diff(cuts, prepend=-1)
                flats.append(ids)
                order += chunk
        rest = np.flatnonzero(sizes == 0).tolist()
        for i, ids in zip(rest, self._whole([new[i] for i in rest])):
            sizes[i] = len(ids)
            flats.append(np.asarray(ids, np.uint32))
            order.append(i)
        return sizes, np.concatenate(flats), order

    def _keep(self, h: np.ndarray, ends: np.ndarray, sizes: np.ndarray, flat: np.ndarray, order: list[int]) -> None:
        """Append the ids of new pre-tokens; ``flat`` holds them in ``order``."""
        n = len(sizes)
        for name, values in (("hashes", h), ("ends", ends), ("sizes", sizes), ("again", False)):
            held = _room(getattr(self, name), self.known + n)
            held[self.known : self.known + n] = values
            setattr(self, name, held)
        self.starts = _room(self.starts, self.known + n)
        self.ids = _room(self.ids, self.filled + len(flat))
        in_order = sizes[order]
        self.starts[self.known + np.asarray(order, np.int64)] = self.filled + np.cumsum(in_order) - in_order
        self.ids[self.filled : self.filled + len(flat)] = flat
        self._insert(self.known, h)
        self.known += n
        self.filled += len(flat)

    def _chunk(self, text: str, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts that each end with \\0, and how many there are up to and with each \\0."""
        if self.known > min(self.limit, len(self.slots) // 2):
            self._make_room()
        start, h, ends = split(text, self.words)
        mark = ends == 1 << 32
        entry = self._look_up(h, ends)
        self.again[entry[entry >= 0]] = True
        missing = np.flatnonzero((entry < 0) & ~mark & (ends >> 32 <= LONGEST))
        if len(missing):
            _, first = np.unique(h[missing], return_index=True)
            new = missing[first]
            stop = start[new] + (ends[new] >> 32)
            learned = self._learn([text[a:b] for a, b in zip(start[new].tolist(), stop.tolist())])
            self._keep(h[new], ends[new], *learned)
            entry[missing] = self._look_up(h[missing], ends[missing])
        known = entry >= 0
        sizes, starts = self.sizes[entry].astype(np.int64), self.starts[entry].astype(np.int64)
        extra = [np.array([end or 0], np.uint32)]
        sizes[mark], starts[mark] = end is not None, self.filled
        # ids of what isn't kept follow those of the cache for the time of this call
        other = np.flatnonzero(~known & ~mark)
        if len(other):
            stop = start[other] + (ends[other] >> 32)
            found = self._whole([text[a:b] for a, b in zip(start[other].tolist(), stop.tolist())])
            n = np.fromiter(map(len, found), np.int64, len(found))
            sizes[other], starts[other] = n, self.filled + 1 + np.cumsum(n) - n
            extra += [np.asarray(x, np.uint32) for x in found]
        more = np.concatenate(extra)
        self.ids = _room(self.ids, self.filled + len(more))
        self.ids[self.filled : self.filled + len(more)] = more
        return spread(self.ids, starts, sizes), np.cumsum(sizes)[mark]

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32) and each text's count; ``end`` is appended to each text."""
        n = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        held: list[str] = []
        first = size = 0

        def flush(upto: int) -> None:
            nonlocal held, first, size
            if held:
                ids, ends = self._chunk("\0".join(held) + "\0", end)
                n[first:upto] = np.diff(ends, prepend=0)
                out.append(ids)
            held, first, size = [], upto, 0

        for i, text in enumerate(texts):
            text = text or ""
            plain = self._plain(text)
            if plain is None or len(text) > 2 * CHUNK:
                flush(i)
                parts = [np.asarray(self._whole([text])[0], np.uint32)] if plain is None else [self._chunk(p + "\0", None)[0] for p in _pieces(plain)]
                parts += [] if end is None else [np.array([end], np.uint32)]
                n[i] = sum(map(len, parts))
                out += parts
                first = i + 1
                continue
            held.append(plain)
            size += len(text) + 1
            if size >= CHUNK:
                flush(i + 1)
        flush(len(texts))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), n


def _pieces(text: str):
    """Parts of a long plain text that can be encoded on their own."""
    lo = 0
    while lo < len(text):
        m = _CUT.search(text, lo + CHUNK)
        hi = m.start() if m else len(text)
        yield text[lo:hi]
        lo = hi


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for all i, one after another."""
    before = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    return flat[np.repeat(starts - before, sizes) + np.arange(total)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
