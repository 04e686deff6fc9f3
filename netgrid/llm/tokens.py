"""Token ids of whole texts with a public tokenizer, one lookup per word.

For the two kinds of vocabulary in use, a single space between two other
characters always parts a text into pieces that are encoded independently, as
does the border between a letter or digit and the punctuation behind it. Each
distinct part goes through the tokenizers library once per worker and round.
"""

from __future__ import annotations

import os
import re
from array import array

import public_tokenizers
from tokenizers import Tokenizer

#: A worker keeps the pieces of the last one or two rounds of so many.
ROUND = 200_000
#: Pieces longer than this are encoded but not kept.
LONGEST_KEPT = 64
_other_space = re.compile(r"[^\S \n]")
_tight_space = re.compile(r"(?<=\S) (?=\S)")
_tail = ".,!?#%&*$;:|"  # no apostrophe: it may begin a contraction
_plain = "ɐ"  # below it, Python and the library agree on what a letter is
_bare = "\0"  # marks the key of a piece that no space leads


class _Store(dict):
    """Pieces by key; one that is missing is made and kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = value
        return value


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next above 255."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, packed in bytes.

    leading: the vocabulary joins a space to the word behind it (byte-level);
    else white space is dropped and case is folded (words with an end mark).
    """

    def __init__(self, file: str, leading: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        # as the library does by default, their strings in a text become one id
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.I).search if special else None
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.leading = leading
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young, self.old = _Store(self._make), {}

    def _make(self, key: str) -> bytes:
        if key in self.old:
            return self.old[key]
        if key.isalpha() and max(key) < _plain and "İ" not in key:
            return self._word(key)
        atoms = self._atoms(key)
        if len(atoms) > 1 or atoms[0] != key:
            return b"".join([self.young[a] for a in atoms])
        if self.leading:
            key = key[1:] if key[:1] == _bare else " " + key
        return array("I", self.tokenizer.encode(key, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A run of letters is one piece for the library's model too, without its splitting rules."""
        word = " " + word if self.leading else word.lower()
        if self.leading or not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _pieces(self, text: str) -> list[str]:
        if _bare in text:  # keeps keys apart
            return [text]
        if self.leading and ("  " in text or " \n" in text or "\n " in text or _other_space.search(text)):
            return _tight_space.split(text)
        return text.split(" ")

    def _atoms(self, key: str) -> list[str]:
        """The keys whose ids make up those of a key, in order."""
        bare = _bare if self.leading else ""
        mark, piece = (bare, key[1:]) if bare and key[:1] == bare else ("", key)
        lines = piece.split("\n")
        if "" in lines or not piece or _other_space.search(piece) or " " in piece or _bare in piece:
            return [key]
        out = []
        for i, line in enumerate(lines):
            if i:
                mark = bare
                if self.leading:
                    out.append(bare + "\n")
            core = line.rstrip(_tail)
            if len(core) < len(line) and core and core[-1].isalnum() and core[-1] < _plain and core[-1] != "İ":  # lower case: i and a mark
                out += [mark + core, bare + line[len(core) :]]
            else:
                out.append(mark + line)
        return out if self.leading else [x.lower() if x.isascii() else x for x in out]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty. A text with the string of a special token goes to the library whole."""
        out = []
        for t in texts:
            if t and self.special and self.special(t):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
                continue
            pieces = self._pieces(t or "")
            if self.leading:
                pieces[0] = _bare + pieces[0]
            out.append(b"".join(map(self.young.__getitem__, pieces)))
        if len(self.young) > ROUND:
            self.old, self.young = self.young, _Store(self._make)
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, leading: bool) -> Encoder:
    """The worker's encoder of this file."""
    if (file, leading) not in _encoders:
        _encoders[file, leading] = Encoder(file, leading)
    return _encoders[file, leading]


def slices(n: int, size: int = 256):
    return ((i, min(i + size, n)) for i in range(0, n, size))
