"""Exact encoding of whole texts with a public tokenizer, sped up by a bounded cache of pieces.

Texts are cut at places that no pre-token of either tokenizer crosses and whose two sides read alike alone: between a
letter and ASCII punctuation (but not behind an apostrophe, which may begin a contraction), and, where white space
counts, before the white space that follows anything else and behind a lone line end.  The ids of the pieces, joined,
are the ids of the text.  Many texts are cut at once, by a table over the kinds of three neighbouring characters.
Texts with characters on whose class the libraries differ (U+001C to U+001F) are encoded whole.

For a tokenizer that lower-cases, letters below U+0300 are lowered first, where no combining mark is about (there
normalising to composed characters and lower-casing commute).  Only pieces that are new go to the library, many in
one text, divided by a separator that is a pre-token and a token of its own.

Where white space counts, the pieces stay places in the UTF-8 bytes.  The short ones are looked up in arrays, all at once;
of those that are not there, words are merged side by side (:mod:`hornfels.llm.pieces`), and only the others become
strings for the cache and the library.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from itertools import chain

import numpy as np

from hornfels.llm.pieces import SHORT, Short, distinct, keys_of, pairs_of

PIECES = 400_000
"""Entries of each of the two generations of the cache of a Python worker."""
LONGEST = 200
"""Characters of what the cache keeps."""
SLOTS, POOL = 20, 6_000_000
"""Of the arrays before the cache: 2**``SLOTS`` pieces, and ids after which they are emptied."""
WINDOW = 2_000_000
"""Characters of a longer text that are cut at once."""
JOINED, CALL = 24, 170
"""New pieces in one text, and texts in one call of the library."""

_LETTER, _MARK, _APOSTROPHE, _SPACE, _LINE, _COMBINING, _OTHER, _END = range(8)
_KNOWN, _LOW = 0x3000, 0x300


def _kind(c: str) -> int:
    if c == "\n":
        return _LINE
    if c.isspace():
        return _END if c in "\x1c\x1d\x1e\x1f" else _SPACE
    if c.isalpha():
        return _LETTER
    if unicodedata.category(c)[0] == "M":
        return _COMBINING
    if "!" <= c <= "~" and not c.isalnum():
        return _APOSTROPHE if c == "'" else _MARK
    return _OTHER


def _between(a: int, b: int, c: int, words: bool) -> bool:
    """Whether a text may be cut before the last of three characters of these kinds."""
    space = (_SPACE, _LINE)
    if (b == _LETTER and c in (_MARK, _APOSTROPHE)) or (b == _MARK and c == _LETTER):
        return True
    if words or c == _END or b == _END:
        return False
    if c in space:
        return b not in space
    return b == _LINE and a not in space and a != _END


_KINDS = np.array([_kind(chr(c)) for c in range(_KNOWN)] + [_OTHER], np.uint16)
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_LOW)], "<u4")
_CUTS = {words: np.array([_between(k >> 6, k >> 3 & 7, k & 7, words) for k in range(512)]) for words in (False, True)}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives the ids of each text as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, words: bool):
        """words: the tokenizer lower-cases and drops white space, so pieces need not carry it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = words
        self.cache = _Cache(PIECES)
        self.short = None if words else Short(SLOTS, POOL)
        self.pairs = None if words else pairs_of(json.loads(self.tokenizer.to_str()))
        self.separator = " | " if words else "\n"
        ids = self._library(["a" + self.separator + "b"])[0]
        self.separator_id = ids[1] if len(ids) == 3 else -1

    def _library(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), CALL * JOINED):
            out += [np.array(ids, "<u4").tobytes() for ids in self._library(texts[at : at + CALL * JOINED])]
        return out

    def _simple(self, piece: str) -> bool:
        """The separator stays a token of its own around it."""
        body = piece[1:] if piece[:1] == " " else piece
        return body.isalpha() or (body != "" and body.isascii() and body.isprintable() and " " not in body and "|" not in body)

    def _raw(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by the library."""
        simple = [p for p in pieces if self._simple(p)] if self.separator_id >= 0 else []
        known: dict[str, bytes] = {}
        for at in range(0, len(simple), CALL * JOINED):
            own = simple[at : at + CALL * JOINED]
            got = self._library([self.separator.join(own[a : a + JOINED]) + self.separator for a in range(0, len(own), JOINED)])
            flat = np.fromiter(chain.from_iterable(got), "<u4", sum(map(len, got)))
            ends = (np.flatnonzero(flat == self.separator_id) * 4).tolist()
            if len(ends) == len(own):  # else a piece reads otherwise beside a separator
                raw = flat.tobytes()
                known.update(zip(own, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]))
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self._alone(rest)))
        return [known[p] for p in pieces]

    def _marks(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character."""
        kinds = np.concatenate([np.full(2, _END, np.uint16), kinds])
        return _CUTS[self.words][kinds[:-2] << 6 | kinds[1:-1] << 3 | kinds[2:]]

    def cut(self, texts: list[str]) -> list[list[str]]:
        """Pieces of each text; texts have none of U+001C to U+001F."""
        codes = np.frombuffer("\x1d".join(texts).encode("utf-32-le"), "<u4")
        kinds = _KINDS.take(codes.astype(np.intp), mode="clip")
        if self.words and codes.size and not (kinds == _COMBINING).any():
            codes = np.where(codes < _LOW, _LOWER[np.minimum(codes, _LOW - 1)], codes)
        cuts = np.flatnonzero(self._marks(codes, kinds))
        marked = np.insert(codes, cuts, 0x1E).tobytes().decode("utf-32-le").split("\x1d")
        return [t.split() for t in marked] if self.words else [t.split("\x1e") for t in marked]

    def places(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, where in them the pieces begin and end, how many characters are no letters, and the first piece of each text."""
        whole = "\x1d".join(texts) + "\x1d"
        raw, codes = whole.encode(), np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds = _KINDS.take(codes.astype(np.intp), mode="clip")
        marks = np.append(self._marks(codes, kinds), True)
        divided = np.flatnonzero(codes == 0x1D)
        marks[divided + 1] = marks[0] = True
        bounds = np.flatnonzero(marks)
        others = np.diff(np.append(0, np.cumsum(kinds != _LETTER, dtype=np.int32)).take(bounds))
        last = np.searchsorted(bounds, divided + 1)  # bounds behind the separators; pieces end before these
        others[last - 1] -= 1
        if len(raw) > len(codes):
            at = np.flatnonzero(np.frombuffer(raw, np.int8) >= -64)  # first bytes of characters
            bounds[:-1] = at[bounds[:-1]]
            bounds[-1] = len(raw)
        ends = bounds[1:].copy()
        ends[last - 1] -= 1
        return raw, bounds[:-1], ends, others, np.append(0, last)

    def encode(self, texts: list[str]) -> list[bytes]:
        if any(len(t) > WINDOW for t in texts):
            return [b"".join([self._encode([w])[0] for w in windows(t)]) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [t for t in texts if not _odd(t)]
        done = iter((self._ids(self.cut(plain)) if self.words else self._by_places(plain)) if plain else [])
        return [self._alone([t])[0] if _odd(t) else next(done) for t in texts]

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces, joined."""
        wanted: set[str] = set()
        for own in lists:
            wanted.update(own)
        new = self.cache.missing(wanted)
        known = self.cache.new
        known.update(zip(new, self._raw(new)))
        get = known.__getitem__
        out = [b"".join(map(get, own)) for own in lists]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def _by_places(self, texts: list[str]) -> list[bytes]:
        raw, begins, ends, others, firsts = self.places(texts)
        first, second, n = keys_of(raw, begins, ends)
        starts, sizes, slots = self.short.find(first, second, n)
        new = np.flatnonzero(sizes < 0)
        if len(new):
            space = (first[new] & np.uint64(255)) == ord(" ")
            words = (others[new] == space) & (n[new] > others[new]) & (n[new] <= SHORT) & (self.pairs is not None)
            some, rest = new[words], new[~words]
            if len(some):
                of, which = distinct(first[some], second[some])
                ids, own = self.pairs.merge(first[some[of]], second[some[of]])
                starts[some], sizes[some] = self.short.keep(ids, own, which)
            if len(rest):
                number: dict[str, int] = {}
                which = np.array([number.setdefault(raw[a:b].decode(), len(number)) for a, b in zip(begins[rest].tolist(), ends[rest].tolist())])
                parts = self._ids([[p] for p in number])
                own = np.array([len(p) // 4 for p in parts])
                starts[rest], sizes[rest] = self.short.keep(np.frombuffer(b"".join(parts), "<u4"), own, which)
            self.short.point(first, second, slots, new[(n[new] > 0) & (n[new] <= SHORT)], starts, sizes)
        stops = np.cumsum(sizes)
        ids = self.short.pool[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1])].tobytes()
        bounds = (4 * np.append(0, stops)[firsts]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


class _Cache:
    """Two generations: what is not asked for while one fills is forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those that neither generation has; the others are in ``new`` afterwards."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = []
        for c in wanted.difference(new):
            if (ids := old.get(c)) is None:
                out.append(c)
            else:
                new[c] = ids
        return out


def windows(text: str) -> list[str]:
    """A very long text in parts that read alike alone: each but the first begins with a lone space."""
    out, at = [], 0
    while not _odd(text) and len(text) - at > WINDOW:
        p = text.find(" ", at + WINDOW)
        while 0 < p < len(text) - 1 and (text[p - 1].isspace() or text[p + 1].isspace()):
            p = text.find(" ", p + 1)
        if not 0 < p < len(text) - 1:
            break
        out.append(text[at:p])
        at = p
    return [*out, text[at:]]


def _odd(text: str) -> bool:
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


@functools.cache
def encoder(path: str, words: bool) -> Encoder:
    """One for each Python worker, which Spark reuses from task to task."""
    return Encoder(path, words)


def groups(texts: list[str], chars: int = 1_000_000):
    """Slices of ``texts`` of about ``chars`` characters each, so that memory stays bounded."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
