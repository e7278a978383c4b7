"""Token ids of whole texts with a public tokenizer file, one word at a time.

``word_bpe_49k.json`` drops white space and never merges across it, so a text's
ids are the ids of its space-separated words in order.  Words repeat, so each
worker keeps the ids of words (and of their letter, digit and punctuation
pieces) it has met, as packed 16-bit ids in bounded dictionaries.  Words of
printable ASCII and Latin-1 letters are split into pieces here and merged by the
library's BPE model; every other word goes through the library's full encoder.
"""

from __future__ import annotations

import re
from array import array

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Entries of either dictionary before it is emptied.
REMEMBERED = 400_000

# What the tokenizer file states as its pieces, for printable ASCII and Latin-1 letters.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")
# Fixed value: byte-level vocabularies write these bytes as themselves and the others as chr(256 + n).
AS_THEMSELVES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Ids:
    """Packed little-endian 16-bit ids of texts."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.merge = self.tokenizer.model.tokenize
        others = [b for b in range(256) if b not in AS_THEMSELVES]
        self.byte = {b: chr(b) for b in AS_THEMSELVES} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}          # what ``words`` held before it was last emptied
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the dictionaries, so that a worker that goes on to other work does not hold them."""
        for known in (self.words, self.older, self.pieces):
            known.clear()

    def _piece(self, piece: str, word: bool = False) -> bytes:
        """Ids of a piece; one that is a word itself is remembered as a word only."""
        got = self.pieces.get(piece) or self.words.get(piece) or self.older.get(piece)
        if got is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            mapped = piece if piece.isascii() else "".join(map(self.byte.__getitem__, piece.encode()))
            got = array("H", [t.id for t in self.merge(mapped)]).tobytes()
            if not word:
                self.pieces[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self._piece(word.lower(), word.islower())
        if PLAIN.fullmatch(word) and "<|" not in word:
            pieces = PIECES.findall(word.lower())
            return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.words)
        if new:
            if len(self.words) >= REMEMBERED:
                self.older, self.words = self.words, {}
                new = set(words)
            old, word = self.older.get, self._word
            self.words.update((w, old(w) or word(w)) for w in new)
        out = b"".join(map(self.words.__getitem__, words))
        for w in new:                               # very long words are not worth remembering
            if len(w) > 100:
                del self.words[w]
        return out


_loaded: dict[str, Ids] = {}


def ids(name: str = VOCABULARY) -> Ids:
    """This worker's encoder for the vocabulary file ``name`` of the public tokenizers."""
    if name not in _loaded:
        _loaded[name] = Ids(public_tokenizers.path(name))
    return _loaded[name]
