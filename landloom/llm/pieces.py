"""Encoding by pieces: cut where the tokenizer can never merge, look each piece up.

A tokenizer's merges stay inside the runs its pre-tokenizer cuts. Pieces that
end on such a cut can be encoded on their own and put together again. Natural
text repeats its pieces, so the library encodes each distinct piece once per
worker. A table that has grown to ``MOST`` pieces becomes the older one, from which
pieces still in use move over; so memory is bounded and no result changes.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

MOST = 400_000
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Marks that a pre-token never shares with the letter before them.
MARKS = b".,;:!?"
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: White space beyond the ASCII kind; texts with it are not cut into pieces.
ODD_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
ODD_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
RUN = re.compile(rb"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 stands for itself, the others follow from U+0100 upward.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


def single_run(settings: dict) -> tuple[re.Pattern, bool] | None:
    """Pieces that are one run of letters for this tokenizer, and whether it lower-cases them.

    Such a piece needs no normalizer and no pre-tokenizer: the model alone gives its ids.
    """
    before, norm = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return re.compile(" ?" + WORD), False
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", ())]
    parts = before.get("pretokenizers", ())
    if kinds == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and r"[\p{L}]+" in parts[0]["pattern"].get("Regex", ""):
        return re.compile(WORD), True
    return None


class Pieces(dict):
    """Piece (UTF-8) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.single = single_run(json.loads(self.tokenizer.to_str()))
        # Byte-level vocabularies: a piece's parts are cut as their pre-tokenizer does; marks of special tokens go to the library.
        self.parts = regex.compile(public_tokenizers.PATTERN) if self.single and not self.single[1] else None
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None and len(piece) > 1 and piece[-1] in MARKS and piece[-2] in LETTERS:
            ids = self[piece[:-1]] + self[piece[-1:]]
        self[piece] = ids = self.piece(piece) if ids is None else ids
        return ids

    def piece(self, piece: bytes) -> bytes:
        """Ids of a piece that is not known yet."""
        text = piece.decode("utf-8", "replace")
        if self.parts is not None and b"<|" not in piece:
            ids = array("I")
            for part in (text,) if self.single[0].fullmatch(text) else self.parts.findall(text):
                ids.extend([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])
            return ids.tobytes() if LITTLE else np.asarray(ids, dtype="<u4").tobytes()
        if self.single is None or not self.single[0].fullmatch(text):
            return self.whole(piece)
        if self.single[1]:
            piece = text.lower().encode()
        tokens = self.model.tokenize(piece.decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def whole(self, text: bytes) -> bytes:
        """Ids of ``text`` straight from the library."""
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def bounded(self) -> None:
        if len(self) > MOST:
            self.older = dict(self)
            self.clear()

    def release(self, most: int = MOST // 4) -> None:
        """Give memory back at the end of a task: other stages use the same worker."""
        if len(self) + len(self.older) > most:
            self.clear()
            self.older = {}
            pa.default_memory_pool().release_unused()

    def words(self, text: bytes) -> bytes:
        """For tokenizers that drop white space: pieces are the words."""
        self.bounded()
        return b"".join([self[w] for w in text.split()])

    def runs(self, text: bytes) -> bytes:
        """For byte-level tokenizers: pieces are white space and the word after it.

        A non-white character before white space always ends a pre-token, so
        the cut is exact for ASCII white space; other kinds go to the library whole.
        """
        if not text.isascii() and any(lead in text for lead in ODD_LEADS) and ODD_WHITE.search(text):
            return self.whole(text)
        self.bounded()
        return b"".join([self[w] for w in RUN.findall(text)])


@functools.cache
def pieces(path: str) -> Pieces:
    """One table per worker process and tokenizer file."""
    return Pieces(path)


@functools.cache
def token_strings(path: str) -> list[bytes]:
    """UTF-8 of the token of each id."""
    tokenizer = pieces(path).tokenizer
    return [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
