"""Whole texts to ids with the tokenizers library, pieces between blanks kept in a table.

The library does the encoding, but for a piece (a run without ASCII white space) that a
worker has met lately its table has the ids.  That is exact for vocabularies whose
normalizer and pre-tokenizer never look across white space, which ``by_piece`` checks
against the vocabulary file: it accepts lower-casing, NFC and white-space replacement,
and a pre-token pattern that keeps letters, digits and marks apart.  A new piece is cut
where that pattern cuts it; a pre-token of plain letters goes to the library's model,
anything else through the whole of the library.  Any other vocabulary file is encoded
text by text.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .bpe import byte_letters

#: Entries after which a worker's table becomes its old one, which is asked second.
TABLE_PIECES = 400_000
#: Fixed value: the pre-token pattern that pieces are cut by.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that lower-case one by one and are in normal form, digits, and marks but the apostrophe.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PLAIN = re.compile(LETTERS.pattern + r"|[0-9]|[!-&(-/:-@\[-`{-~]+")

#: Marks that often end a piece.
TAIL = b".,;:!?)"


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def by_piece(spec: dict) -> bool:
    """Whether texts can be encoded piece by piece."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal])
    kinds = [s.get("type") for s in steps]
    safe = "Lowercase" in kinds and all(k in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for k, s in zip(kinds, steps))
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[:1] == [{"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True}]
    level = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    strict = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return bool(safe and split and level and strict)


class Pieces(dict):
    """UTF-8 pieces to ids as little-endian unsigned 32-bit numbers; a missing one is encoded."""

    def __init__(self, library, special: list[str]):
        super().__init__()
        self.library, self.model, self.special, self.old = library, library.model, special, {}
        self.letters = dict(enumerate(byte_letters()))
        # no special token lies within letters or within the marks behind them
        self.bare = all(set(s) - set(string.ascii_letters) and set(s) - set(TAIL.decode()) and not re.search(r"[A-Za-z][.,;:!?)]", s) for s in special)

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids

    def encode(self, piece: bytes) -> bytes:
        word = piece.rstrip(TAIL)
        if self.bare and (low := word.lower().decode() if word.isalpha() else self.level(word.decode())):
            # letters, and perhaps marks behind them: two pre-tokens
            ids = packed([t.id for t in self.model.tokenize(low)])
            return ids if len(word) == len(piece) else ids + self[piece[len(word) :]]
        text = piece.decode()
        parts = PLAIN.findall(text)
        if "".join(parts) == text and not any(s in text for s in self.special):
            if len(parts) > 1:
                return b"".join([self[p.encode()] for p in parts])
            if low := self.level(text):
                return packed([t.id for t in self.model.tokenize(low)])
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def level(self, text: str) -> str:
        """Lower-case letters as the model's letters for their bytes; empty if it isn't plain letters."""
        return text.lower().encode().decode("latin-1").translate(self.letters) if LETTERS.fullmatch(text) else ""

    def turn(self) -> None:
        """Forget what has not been met since the last turn, once the table is full."""
        if len(self) > TABLE_PIECES:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """From texts to ids as little-endian unsigned 32-bit numbers, one table for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not by_piece(spec):
        return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    table = Pieces(library, [t["content"] for t in spec["added_tokens"]])

    def encode(texts: list[str]) -> list[bytes]:
        table.turn()
        get = table.__getitem__
        return [b"".join(map(get, t.encode("utf-8", "replace").split())) for t in texts]

    return encode
