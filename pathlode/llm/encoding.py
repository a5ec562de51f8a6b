"""Token ids of whole texts, as the tokenizers library gives them.

Byte-level BPE never merges across the pieces its pre-tokenizer cuts, so a text's
ids are those of its pieces in turn. Each worker therefore asks the library once per
distinct piece and keeps the answer, which saves most of the work on running text.
Texts with characters for which two regular-expression engines could disagree, or
with the string of an added token, go to the library whole.
"""

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Sequence

from tokenizers import Tokenizer

# Answers kept per worker, of pieces and of runs each (about 200 bytes an answer). Fewer cost
# time, more cost memory; results do not depend on it.
KEPT = 800_000

_BLANKS = " \t\n\r"
_SAFE = [
    c
    for c in map(chr, [*range(0x20, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)])
    if unicodedata.category(c)[0] in "LNPS" and c != "\xad"
]


def _class(first: str) -> str:
    return "".join(re.escape(c) for c in _SAFE if unicodedata.category(c)[0] == first)


_LETTERS, _NUMBERS = _class("L"), _class("N")
_UNSAFE = re.compile(f"[^{_BLANKS}{re.escape(''.join(_SAFE))}]")
# The byte-level pre-tokenizer's pattern, spelt out for the safe characters.
_PIECES = re.compile(
    rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+"
    rf"| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
# A space beside another blank belongs to a longer piece, so runs between spaces are not free.
_DOUBLED = [f"{a}{b}" for a in _BLANKS for b in _BLANKS if " " in (a, b)]

# A control character, so no safe text has it: before a sign that is cut off the word it stands behind.
_CUT = "\x01"
_SIGNS = [(f"{sign} ", f" {_CUT}{sign} ") for sign in ",."]
# Such a sign belongs to a longer piece if no letter or number stands before it.
_STUCK = re.compile(f"[^{_LETTERS}{_NUMBERS}] {_CUT}")


def _by_pieces(config: dict) -> bool:
    cut = config.get("pre_tokenizer") or {}
    return (
        config["model"]["type"] == "BPE"
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and not any(config.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    )


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Known(dict):
    """Answers in two generations: what is asked for again outlives the next change of them.

    When the young half is full it becomes the old one, whose other answers are forgotten.
    """

    def __init__(self, kept: int):
        self.most, self.old = max(kept // 2, 1), {}

    def known(self, text: str) -> bytes | None:
        """The old answer, kept for another generation."""
        ids = self.old.pop(text, None)
        if ids is not None:
            self.keep(text, ids)
        return ids

    def keep(self, text: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[text] = ids


class _Pieces(_Known):
    """Piece -> ids as little-endian unsigned 32-bit integers; asks the library when missing."""

    def __init__(self, tokenizer: Tokenizer, kept: int):
        super().__init__(kept)
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()
        self.bytes = {i: id_bytes([i]) for i in tokenizer.get_vocab().values()}
        self.space = self.letters[0x20]

    def ask(self, piece: str) -> bytes:
        spelt = piece.encode().decode("latin-1").translate(self.letters)
        return self.spelt(spelt)

    def ask_word(self, word: str) -> bytes:
        """The ids of a space and a word."""
        if word.isascii():  # such letters are spelt as themselves
            return self.spelt(self.space + word)
        return self.ask(f" {word}")

    def spelt(self, piece: str) -> bytes:
        of = self.bytes
        return b"".join([of[t.id] for t in self.tokenize(piece)])

    def __missing__(self, piece: str) -> bytes:
        ids = self.known(piece)
        if ids is None:
            ids = self.ask(piece)
            self.keep(piece, ids)
        return ids


class _Runs(_Known):
    """Run between single spaces -> ids of the space and the run.

    Only words and numbers and the like are kept: a word and the sign behind it are looked up on
    their own, and runs across line ends hardly ever come again. A sign cut off its word is a run too.
    """

    def __init__(self, pieces: _Pieces, kept: int):
        super().__init__(kept)
        self.pieces = pieces

    def __missing__(self, run: str) -> bytes:
        if run.isalpha():
            ids = self.known(run)
            if ids is None:
                ids = self.pieces.ask_word(run)
                self.keep(run, ids)
            return ids
        if run[:1] == _CUT:
            self.keep(run, self.pieces[run[1:]])
            return self[run]
        word, last = run[:-1], run[-1:]
        if word.isalpha() and last not in _BLANKS and not last.isalnum():
            return self[word] + self.pieces[last]
        if "\n" in run:
            first, *rest = _PIECES.findall(f" {run}")
            ids = self[first[1:]] if first[1:].isalpha() else self.pieces[first]
            return ids + b"".join(map(self.pieces.__getitem__, rest))
        ids = self.known(run)
        if ids is None:
            ids = self.pieces_of(f" {run}")
            self.keep(run, ids)
        return ids

    def pieces_of(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))


def id_bytes(ids: Sequence[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """Ids of texts by one ``.json`` tokenizer; kept per worker by ``encoder``."""

    def __init__(self, path: str, kept: int = KEPT):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.added = [t["content"] for t in config.get("added_tokens") or ()]
        self.runs = _Runs(_Pieces(self.tokenizer, kept), kept) if _by_pieces(config) else None

    def encode(self, text: str) -> bytes:
        """Ids without begin, end or template tokens, four bytes each."""
        if self.runs is None or _UNSAFE.search(text) or any(a in text for a in self.added):
            return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text[:1] == " " or text[-1:] == " " or any(d in text for d in _DOUBLED):
            return self.runs.pieces_of(text)
        parted = text
        for sign, cut in _SIGNS:
            parted = parted.replace(sign, cut)
        first, *rest = (text if _STUCK.search(parted) else parted).split(" ")
        return self.runs.pieces_of(first) + b"".join(map(self.runs.__getitem__, rest))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One encoder per worker, file and bound. The file must lie at ``path`` on every executor."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = Encoder(path, kept)
    return _ENCODERS[path, kept]
