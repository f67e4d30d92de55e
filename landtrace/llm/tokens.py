"""Token ids of whole texts inside executor tasks, with a cache of the words seen.

The tokenizer drops white space, never merges across it, and encodes the pieces of its own split
one by one. A text of plain Latin letters, digits and ASCII signs is cut into these pieces here;
new pieces are encoded together, since each ends with an end-of-word token, and looked up from
then on. Any other text is cut at blanks only and its words are encoded and looked up whole. The
caches belong to the Python worker and hold a bounded number of entries: when one is full it is
set aside, and of what was set aside those that come again are taken back.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np

from landtrace.llm.common import ship

MOST_WORDS = 400_000
BLANK = re.compile(r"[ \t\n\x0b\f\r]+")
PLAIN = re.compile(r"[ \t\n\x0b\f\r!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\x0b\f\ra-zß-öø-ÿ0-9]+")


class Cache:
    """At most about twice ``most`` words, the ones in use among them."""

    def __init__(self, most: int):
        self.most, self.known, self.aside = most, {}, {}

    def missing(self, words: set[str]) -> set[str]:
        """Make room, take back what was set aside, and return what isn't there."""
        if len(self.known) + len(words) > self.most:
            self.known, self.aside = {}, self.known
        new = words.difference(self.known)
        back = new.intersection(self.aside)
        self.known.update((w, self.aside[w]) for w in back)
        return new - back


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.pieces = Cache(most_words), Cache(most_words)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        known = self.pieces.known
        for lo in range(0, len(new), 500):
            some = new[lo:lo + 500]
            ids = np.array(self._encode([" ".join(some)])[0], dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                at = [0, *(cuts * 4).tolist()]
                raw = ids.tobytes()
                known.update((p, raw[a:b]) for p, a, b in zip(some, at, at[1:]))
            else:
                self._learn_words(some, known)

    def _learn_words(self, new: list[str], known: dict[str, bytes]) -> None:
        for lo in range(0, len(new), 1000):
            for w, one in zip(new[lo:lo + 1000], self._encode(new[lo:lo + 1000])):
                known[w] = np.array(one, dtype="<u4").tobytes()

    def _cut(self, text: str | None) -> tuple[bool, list[str]]:
        if not text:
            return True, []
        if PLAIN.fullmatch(text) and not ("<" in text and any(s in text for s in self.specials)):
            return True, PIECE.findall(text.lower())
        return False, [w for w in BLANK.split(text) if w]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        pieces, words = set(), set()
        for plain, parts in cut:
            (pieces if plain else words).update(parts)
        self._learn_pieces(list(self.pieces.missing(pieces)))
        self._learn_words(list(self.words.missing(words)), self.words.known)
        look = {True: self.pieces.known, False: self.words.known}
        return [b"".join(map(look[plain].__getitem__, parts)) for plain, parts in cut]


def worker_tokenizer(path: str) -> WordTokenizer:
    """This Python worker's tokenizer, kept from task to task."""
    kept = sys.modules.setdefault("_landtrace_worker", types.ModuleType("_landtrace_worker")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


ship(__name__)
