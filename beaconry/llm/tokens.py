"""Token ids from a public tokenizer file, with a cache of words.

A text without runs of blanks is cut before every blank: for the patterns of both supported files a cut there always
is a boundary between pre-tokens, so the ids of the parts joined are the ids of the text. The texts of a batch are cut and their parts
numbered by Arrow; each distinct part is cut into pre-tokens once a batch, and only pre-tokens that were not seen lately go through
the tokenizer's merges. Texts with
runs of blanks, special tokens or characters outside the plain Latin ranges take the tokenizer's own ``encode``. A word that ends in a mark is two pre-tokens and needs no pattern.
"""

from __future__ import annotations

import json
from functools import lru_cache
from struct import Struct, pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

CACHE_PIECES = 300_000
#: Characters that are encoded together.
GROUP = 12 << 20
#: Characters on which normalisation is lower-casing alone and all pattern engines agree.
PLAIN = regex.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*")
#: Marks that end most words which are not letters alone.
MARKS = frozenset(".,;:!?")
PACK = [Struct(f"<{n}I").pack for n in range(32)]
PLAIN_LATIN = bytes(c for c in range(256) if PLAIN.fullmatch(chr(c)))
#: The pre-token pattern of byte-level tokenizers whose file only names it (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _plain_letters(text: str) -> bool:
    """``PLAIN`` matches the text; most texts have one byte a character and are looked up as bytes."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN_LATIN)
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else the next letter from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        pre = spec["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        split = [s for s in steps if s["type"] == "Split"]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"] if split else BYTE_LEVEL)
        norm = spec["normalizer"]
        kinds = [n["type"] for n in norm.get("normalizers", [norm])] if norm else []
        self.lower = "Lowercase" in kinds
        self.supported = {s["type"] for s in steps} <= {"Split", "ByteLevel"} and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        self.bare = bool(split)  # pre-tokens come without their blank
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.model = self.tokenizer.model
        self.merge = self.model.tokenize
        # Pre-tokens seen lately and their ids: two generations, so that frequent words outlive a full cache.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merged(self, piece: str) -> bytes:
        """Ids of one pre-token from the tokenizer's merges."""
        if piece.isascii() and (piece.isalpha() or piece[0] == " " and piece[1:].isalpha()):
            mapped = piece.replace(" ", self.blank)
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merge(mapped)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token, from the cache if it was seen lately."""
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self._merged(piece)
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def _part(self, part: str) -> bytes:
        """Ids of a part (a blank, but for the first of a text, and what follows to the next blank) that is not one word."""
        return b"".join(map(self._piece, self.pattern.findall(part)))

    def _table(self, words: list[str], blank: str) -> list[bytes]:
        """Ids of parts, each ``blank`` and a word; letters alone are one pre-token, with their blank or without."""
        before, piece, out = "" if self.bare else blank, self._piece, []
        for w in words:
            if w.isalpha():
                out.append(piece(before + w))
            elif w[-1:] in MARKS and w[:-1].isalpha():  # the mark is a pre-token of its own
                out.append(piece(before + w[:-1]) + piece(w[-1]))
            else:
                out.append(self._part(blank + w))
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, text: str) -> str | None:
        """The text to be cut, in the tokenizer's case; None if it takes the tokenizer's own way."""
        low = text.lower()
        if not self.supported or "  " in text or any(s in low for s in self.special) or not _plain_letters(text):
            return None
        return low if self.lower else text

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of plain texts in the tokenizer's case."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        del texts  # as large as the batch
        ends = np.cumsum(lists.value_lengths().to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        parts = lists.flatten().dictionary_encode()
        del lists
        codes, words = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        table = self._table(words, " ")
        firsts, place = np.unique(codes[starts], return_inverse=True)
        codes[starts] = len(words) + place
        table += self._table([words[i] for i in firsts], "")
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(table), "<u4")))
        return rows.take(pa.array(codes)).flatten().to_numpy(), np.add.reduceat(sizes[codes], starts)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        ready = {i: p for i, t in enumerate(texts) if t and (p := self._plain(t)) is not None}
        plain = list(ready)
        other = {i: self._whole(t) for i, t in enumerate(texts) if t and i not in ready}
        n = np.zeros(len(texts), np.int64)
        flat, found = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain:
            flat, found = self._parts([ready.pop(i) for i in plain])
            n[plain] = found
        if not other:
            return flat, n
        pieces, at, offsets = [], 0, dict(zip(plain, np.cumsum(found) - found))
        for i in range(len(texts)):
            if i in other:
                n[i] = len(other[i])
                pieces.append(other[i])
            elif i in offsets:
                pieces.append(flat[offsets[i] : offsets[i] + n[i]])
        return np.concatenate(pieces), n

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)
