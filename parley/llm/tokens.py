"""Token ids of whole texts with a public tokenizer file.

The tokenizer drops white space before it looks for tokens, so the ids of a text are the ids of its words one after
another. Each task keeps the ids of recent words and asks the library only for new ones. Words are cut at ASCII white
space; any other white space stays inside a word, where the library drops it.
"""

from __future__ import annotations

import array
import os
import sys
import unicodedata

END = 2
CACHE_WORDS = 400_000


def _bytes(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[int, str]:
    """Letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTER = _byte_letters()
_MARKS = b",."
_PLAIN_BELOW = "\u0250"  # Latin letters, where lower case does not depend on what stands around


class WordIds(dict):
    """Little-endian 32-bit ids of a word, by its UTF-8 bytes.

    Two generations bound the memory: when the young one is full, it becomes the old one.
    """

    def __init__(self, tokenizer, limit: int = CACHE_WORDS):
        super().__init__()
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.old: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _stem(self, word: bytes) -> bytes | None:
        """Ids of a word that is one piece of the splitting rule; None if it may not be."""
        if word.isalpha():  # letters A-Z and a-z alone
            key = word.lower()
            ids = self.stems.get(key)
            return self._spell(key, key.decode()) if ids is None else ids
        text = word.decode()
        low = text.lower()
        # Latin letters, composed, that stay letters in lower case.
        if not (text.isalpha() and low.isalpha() and max(text) < _PLAIN_BELOW and unicodedata.is_normalized("NFC", text)):
            return None
        key = low.encode()
        ids = self.stems.get(key)
        return self._spell(key, "".join(map(_LETTER.__getitem__, key))) if ids is None else ids

    def _spell(self, key: bytes, spelled: str) -> bytes:
        """Ids of a piece as the model spells it, byte by byte."""
        ids = _bytes([t.id for t in self.model.tokenize(spelled)])
        if len(self.stems) >= self.limit:
            self.stems.clear()
        self.stems[key] = ids
        return ids

    def _ask(self, word: bytes) -> bytes:
        mark = word[-1:]
        if mark in _MARKS and len(word) > 1:
            # A letter and a mark never share a piece.
            ids = self._stem(word[:-1])
            if ids is not None:
                return ids + self[mark]
        else:
            ids = self._stem(word)
            if ids is not None:
                return ids
        return _bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self._ask(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str | bytes | None, end: int | None = END) -> bytes:
        """Ids of a whole text (or its UTF-8 bytes), then the end id; null counts as empty."""
        data = text.encode() if isinstance(text, str) else text or b""
        parts = [*map(self.__getitem__, data.split())]
        if end is not None:
            parts.append(_bytes([end]))
        return b"".join(parts)


_READY: dict[tuple[str, int], WordIds] = {}


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids(path: str, limit: int = CACHE_WORDS) -> WordIds:
    """Cache of this worker process for one tokenizer file; a smaller one saves memory and asks the library more often."""
    if (path, limit) not in _READY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _READY[path, limit] = WordIds(Tokenizer.from_file(path), limit)
    return _READY[path, limit]
