"""White-space chunks of a text and their token ids, with a bounded memo.

The vocabulary's normaliser composes (NFC), folds white space and lower-cases;
its splitter then cuts pieces that never hold white space.  So the ids of a
text are the ids of its white-space chunks in order, and each distinct chunk
needs encoding once.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import regex

#: The splitter of the vocabulary file.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Unicode white space; str.split() also cuts at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_EXTRA = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks and pieces that a Python worker learns before those it did not meet
#: again since the last time are forgotten; it bounds memory and never changes a result.
MEMO = 150_000
#: Characters of text handled together.
GROUP_CHARS = 2_000_000


def split_chunks(text: str) -> list[str]:
    if any(x in text for x in _EXTRA):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def pieces_of(chunk: str) -> list[str]:
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
    chunk = chunk.lower()
    if chunk.isalpha():
        return [chunk]
    if (head := chunk[:-1]).isalpha() and chunk[-1] in ".,;:!?":
        return [head, chunk[-1]]
    return PIECE.findall(chunk)


class ChunkEncoder:
    """Ids (little-endian 32-bit) of texts, through a piece encoder.

    ``encode_pieces`` takes distinct pieces and returns the id bytes of each.
    ``special`` maps the strings of added tokens to their id bytes; they are
    cut out of the raw text first.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], special: dict[str, bytes], memo: int = MEMO):
        self.encode_pieces = encode_pieces
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.most, self.memo, self.aged = memo, dict(special), {}

    def parts(self, text: str) -> list[str]:
        """Chunks and added tokens in order."""
        if self.cut is None or "<|" not in text or not self.cut.search(text):
            return split_chunks(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out.extend([part] if part in self.special else split_chunks(part))
        return out

    def _unknown(self, keys: set[str]) -> set[str]:
        """Keys that are not remembered; older ones that come again are kept on."""
        unknown = keys.difference(self.memo)
        again = unknown.intersection(self.aged)
        self.memo.update(zip(again, map(self.aged.__getitem__, again), strict=True))
        return unknown - again

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of ``chunks``; a piece is a chunk that is cut no further, so both share the memo."""
        if len(self.memo) > self.most:
            self.memo, self.aged = dict(self.special), self.memo
        single, several = {}, {}
        for x in self._unknown(chunks):
            ps = pieces_of(x)
            if len(ps) == 1:
                single[x] = ps[0]
            else:
                several[x] = ps
        pieces = list(self._unknown(set(single.values()).union(*several.values())))
        if pieces:
            self.memo.update(zip(pieces, self.encode_pieces(pieces), strict=True))
        get = self.memo.__getitem__
        self.memo.update(zip(single, map(get, single.values()), strict=True))
        self.memo.update(zip(several, [b"".join(map(get, ps)) for ps in several.values()], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # many small lists and no cycles: looking for cycles takes a tenth of the time
        try:
            parts = [self.parts(x) for x in texts]
            self.learn(set().union(*parts))
            get = self.memo.__getitem__
            return [b"".join(map(get, p)) for p in parts]
        finally:
            if collects:
                gc.enable()


def groups(texts: Iterable[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of about ``limit`` characters; null becomes empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
