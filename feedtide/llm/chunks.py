"""Cuts texts where byte-level BPE can never join tokens, so that encodings of chunks and words can be kept.

The split pattern of byte-level BPE attaches a space to the word after it. A space followed by anything but
white space therefore always starts a new match, whatever stands before it, and both sides can be encoded alone.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterable

import regex

_SPACE_BEFORE_WORD = re.compile(r" (?=\S)")
#: What often ends a word; at the end of a chunk each is a match of its own.
_ENDINGS = frozenset(".,;:!?)")


def packed_ids(found: Iterable[list[int]]) -> list[bytes]:
    """Lists of ids, each as unsigned 32-bit integers of this machine (as numpy and struct's "<" see them: little-endian)."""
    flat, ends = array("I"), [0]
    for ids in found:
        flat.extend(ids)
        ends.append(4 * len(flat))
    data = flat.tobytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Memory:
    """Ids of texts met before, within a bound of bytes: two generations, so that what is met often stays.

    What is found in the old generation moves to the young one; when that is full it becomes the old one at the next turn.
    Long texts are hardly met again and are not kept beyond a turn.
    """

    LONGEST, ENTRY = 256, 200  # characters of a text that is kept; bytes an entry takes besides its text and ids

    def __init__(self, most_bytes: int):
        self.half, self.used = most_bytes // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.passing: list[str] = []

    def turn(self) -> None:
        for text in self.passing:
            del self.young[text]
        self.passing = []
        if self.used > self.half:
            self.old, self.young, self.used = self.young, {}, 0

    def put(self, texts: list[str], ids: list[bytes], keep: bool = True) -> None:
        """Different texts that aren't known, until the next turn or for longer."""
        self.young.update(zip(texts, ids, strict=True))
        if not keep:
            self.passing += texts
        elif texts and max(map(len, texts)) > self.LONGEST:
            self.passing += (gone := [t for t in texts if len(t) > self.LONGEST])
            kept = len(texts) - len(gone)
            self.used += self.ENTRY * kept + sum(len(t) + len(i) for t, i in zip(texts, ids) if len(t) <= self.LONGEST)
        else:
            self.used += self.ENTRY * len(texts) + sum(map(len, texts)) + sum(map(len, ids))

    def unmet(self, texts: set[str]) -> set[str]:
        """The texts that aren't known. The others are in ``young`` until the next turn."""
        new = texts.difference(self.young)
        again = list(filter(self.old.__contains__, new))
        self.put(again, list(map(self.old.__getitem__, again)))
        new.difference_update(again)
        return new


class ChunkCache:
    """Ids of texts as bytes of unsigned 32-bit integers. ``encode`` makes those of single matches of ``pattern``.

    Chunks and matches met before are remembered, within a bound of bytes. A space and letters are one match, as the pattern
    says, so most chunks need not be searched for matches; a word with a mark behind is told from the word.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], most_bytes: int = 64 * 1024 * 1024):
        self.find = regex.compile(pattern).findall
        self.encode_matches = encode
        self.chunks, self.matches = Memory(most_bytes // 8 * 7), Memory(most_bytes // 8)
        self.endings: dict[str, bytes] = {}

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids of texts that are cut by the pattern alone."""
        found = list(map(self.find, parts))
        self.matches.turn()
        new = list(self.matches.unmet(set().union(*found)))
        self.matches.put(new, self.encode_matches(new))
        get = self.matches.young.__getitem__
        return [get(own[0]) if len(own) == 1 else b"".join(map(get, own)) for own in found]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; about a megabyte of text at a time."""
        out: list[bytes] = []
        at = 0
        gc.disable()  # nothing here is cyclic, and the collector would walk the whole memory again and again
        try:
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1_000_000):
                    size += len(texts[upto])
                    upto += 1
                out += self._some(texts[at:upto])
                at = upto
        finally:
            gc.enable()
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        parts = [text.split(" ") for text in texts]
        known = self.chunks
        known.turn()
        words, ended, good = [], [], []
        for p in known.unmet(set().union(*[own[1:] for own in parts])):
            if p.isalpha():
                words.append(p)
            elif p[-1:] in _ENDINGS and p[:-1].isalpha():
                ended.append(p)
            # A part that is empty or starts with white space was cut at a space that starts no match.
            elif p and not p[0].isspace():
                good.append(p)
        words += known.unmet({p[:-1] for p in ended}.difference(words))
        known.put(words, self.encode_matches([" " + w for w in words]))
        known.put(good, self.encode([" " + p for p in good]))
        if ended and not self.endings:
            self.endings.update(zip(_ENDINGS, self.encode_matches(list(_ENDINGS)), strict=True))
        get = known.young.__getitem__
        known.put(ended, [get(p[:-1]) + self.endings[p[-1]] for p in ended], keep=False)
        out = []
        for text, own, head in zip(texts, parts, self.encode([own[0] for own in parts]), strict=True):
            try:
                out.append(head + b"".join(map(get, own[1:])))
            except KeyError:
                first, *rest = _SPACE_BEFORE_WORD.split(text)
                out.append(b"".join(self.encode([first, *(" " + r for r in rest)])))
        return out
