"""Whole-text tokenising with a public tokenizer, through a bounded cache of word pieces.

A BPE tokenizer with a regex pre-tokeniser never merges across a pre-token, so a text may be cut
wherever every pre-token ends, and equal pieces get equal ids. Most pieces of a corpus repeat, so
encoding each piece once is several times faster than encoding texts, with equal ids.
"""

from __future__ import annotations

import gc
import os
import string
import unicodedata

import numpy as np

#: Whole words, case folded: the tokenizer drops white space and lower-cases.
WORDS = "words"
#: Words with one leading blank: the tokenizer keeps white space in its pre-tokens.
BLANKS = "blanks"

#: Byte-level alphabet of these vocabularies: printable Latin-1 bytes stand for themselves, the
#: others, in order, for the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))


class _Blank(Exception):
    """A piece with inner white space: the text is encoded whole."""


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine (resolved where it is used)."""
    import public_tokenizers

    return name if os.sep in name else public_tokenizers.path(name)


class _Pieces(dict):
    """Piece -> ids as bytes. A piece of letters and closing punctuation is two pre-tokens."""

    def __init__(self, encoder: Encoder, limit: int):
        super().__init__()
        self.encoder, self.limit, self.parts = encoder, limit, {}

    def _part(self, part: str, letters: bool) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.encoder.letters(part) if letters else self.encoder.direct(part)
            if len(self.parts) < self.limit:
                self.parts[part] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        # the tokenizer lower-cases letter by letter: no final form of sigma
        key = piece.replace("Σ", "σ").lower() if self.encoder.cut == WORDS else piece
        head = key.rstrip(string.punctuation)
        if self.encoder.cut == BLANKS and key != "\n" and any(map(str.isspace, key.removeprefix(" "))):
            raise _Blank
        if head.lstrip(" ").isalpha():
            found = self._part(head, True)
            if len(head) < len(key):
                found += self._part(key[len(head):], False)
        else:
            found = self._part(key, False)
        if len(self) < self.limit:
            self[piece] = found
        return found


class Encoder:
    """Text -> little-endian uint32 ids as bytes.

    ``cut`` is WORDS, BLANKS, or None (every text is encoded whole). Strings of special tokens
    in a text are ordinary text. Memory: at most ``limit`` pieces and as many parts; beyond it
    new pieces are encoded but not kept (the frequent ones come first).
    """

    def __init__(self, name: str, cut: str | None, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True
        self.cut = cut
        self.pieces = _Pieces(self, limit)

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def letters(self, part: str) -> bytes:
        """Ids of letters only (one blank before them for BLANKS): one pre-token, so the model is
        asked directly, without the normaliser and the pre-tokeniser."""
        if not (part.isascii() or unicodedata.is_normalized("NFC", part)):
            return self.direct(part)
        shown = part.encode().decode("latin-1").translate(_ALPHABET)
        return np.asarray([t.id for t in self.tokenizer.model.tokenize(shown)], dtype="<u4").tobytes()

    def _cut(self, text: str) -> list[str] | None:
        """Pieces that tokenise alone as in the text; None where blanks adjoin other blanks."""
        if self.cut is None:
            return None
        if self.cut == WORDS:
            return text.replace("\n", " ").split(" ")
        if "  " in text or " \n" in text or "\n\n" in text or "\0" in text:
            return None
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        cut = self._cut(text)
        try:
            return self.direct(text) if cut is None else b"".join(map(self.pieces.__getitem__, cut))
        except _Blank:
            return self.direct(text)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(name: str, cut: str | None) -> Encoder:
    """The worker's encoder of a tokenizer (kept while the Python worker lives)."""
    key = (name, cut)
    if key not in _ENCODERS:
        gc.set_threshold(200_000)  # pieces hold no cycles
        _ENCODERS[key] = Encoder(name, cut)
    return _ENCODERS[key]
