"""Pre-tokens of byte-level tokenizers, looked up by blank-separated chunk."""

from __future__ import annotations

from itertools import chain

import regex

from .common import BoundedCache

#: Fixed value: the public pattern of byte-level BPE vocabularies.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ChunkedPieces:
    """Applies a function to every match of the pattern in a text, through caches of whole chunks.

    A text is cut at blanks between two characters that aren't white space. No match reaches over such a cut:
    a blank there starts a match, and look-ahead behind the last match of a chunk sees white space or the end,
    which are alike to it. Texts with other runs of white space around a blank are matched as a whole.
    of_piece maps the bytes of one match to a value; join folds an iterable of values into one.
    """

    def __init__(self, pattern: str, of_piece, join):
        self.find, self.join = regex.compile(pattern).findall, join
        self.pieces = BoundedCache(of_piece, cap=200_000)
        self.first = BoundedCache(lambda chunk: self.whole(chunk), cap=50_000)
        self.inner = BoundedCache(self._inner)

    def whole(self, text: str):
        get = self.pieces.__getitem__
        return self.join(map(get, [m.encode("utf-8", "surrogatepass") for m in self.find(text)]))

    def _inner(self, chunk: str):
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self.whole(" " + chunk)

    def __call__(self, text: str):
        if not text:
            return self.join(())
        head, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        if not head or head[-1].isspace():
            return self.whole(text)
        values = list(map(self.inner.__getitem__, rest))
        if None in values:
            return self.whole(text)
        return self.join(chain((self.first[head],), values))
