"""Token ids of whole texts through the tokenizers library.

Texts of plain Latin characters (the pattern ``_SAFE``) are cut into the
tokenizer's own pre-tokens by an equivalent expression, and each distinct
pre-token goes through the tokenizer's model once for a while; all other texts
go through the tokenizer as a whole. Both ways give the same ids.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from sys import byteorder

import numpy as np

#: Pre-tokens that one generation of the memory holds; two generations live at once.
GENERATION = 400_000
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = " \n\t"
#: Any character outside: controls, other spaces, soft hyphen, dotted I (its lower case is two characters), other scripts.
_OTHER = re.compile("[^\n\t\x20-\x7e¡-¬®-įı-ɏ]")
_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_SPECIAL = "<|"


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memory(dict):
    """Pre-token to packed ids, in two generations, so that its size is bounded."""

    def __init__(self, model, dtype):
        super().__init__()
        self.tokenize, self.code, self.old = model.tokenize, dtype.char, {}
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            # Letters and marks of ASCII stand for themselves.
            spelled = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array(self.code, [t.id for t in self.tokenize(spelled)])
            if byteorder == "big":
                ids.byteswap()
            got = ids.tobytes()
        self[piece] = got
        return got

    def rest(self) -> None:
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Packed little-endian ids of texts; ``width`` is 2 or 4 bytes an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        kind = repr(self.tokenizer.pre_tokenizer)
        self.lower = "Lowercase" in repr(self.tokenizer.normalizer)
        self.pattern = None
        if "BPE" in type(self.tokenizer.model).__name__:
            if kind.startswith("ByteLevel(add_prefix_space=False") and self.tokenizer.normalizer is None:
                self.pattern = _BYTE_LEVEL
            elif self.lower and r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in kind.replace("\\\\", "\\"):
                self.pattern = _WORD_LEVEL
        self.memory = _Memory(self.tokenizer.model, self.dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of a text; a null text has none."""
        if not text:
            return b""
        if self.pattern is None or _OTHER.search(text) or _SPECIAL in text:
            return self.whole(text)
        self.memory.rest()
        return b"".join(map(self.memory.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary file."""
    return TextEncoder(path)
