"""Token ids of whole texts by the word_bpe vocabulary, equal to the tokenizers library's, at cache speed.

The vocabulary's rules drop white space and never join across it, so a stretch between ASCII
white space has the same ids wherever it stands. A batch of texts is cut at white space and
dictionary-encoded by Arrow; only words not seen lately go through normalisation, splitting into
letters, single digits and punctuation, and the library's model.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from inkgauge.llm.common import kept

#: Words and pieces that one age of a worker's caches holds at most; there are two ages of each.
WORD_CACHE = 250_000
PIECE_CACHE = 150_000
#: Separators on which the vocabulary's patterns and Python's may disagree.
_ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Recent:
    """A dict in two ages: what isn't asked for while an age fills up is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordBpe:
    """Ids for the word_bpe_49k vocabulary, as encode(text, add_special_tokens=False) gives them: a special token's string in a text is that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        made = json.load(open(path))
        self.special = [t["content"] for t in made["added_tokens"]]
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.words, self.pieces = Recent(WORD_CACHE), Recent(PIECE_CACHE)

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
            self.pieces.put(piece, found)
        return found

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if any(t in word for t in self.special):
            return self.whole(word)
        if word.isascii():
            low = word if word.islower() else word.lower()  # one string for both caches
            if low.isalpha():
                return self.piece(low)
        else:
            whole = unicodedata.normalize("NFC", word)
            low = "".join([c.lower() for c in whole]) if "\u03a3" in whole else whole.lower()
        if _ODD.search(low):
            return self.whole(word)
        if low[:-1].isalpha() and low.isascii():
            return self.piece(low[:-1]) + self.piece(low[-1])
        return b"".join([self.piece(p) for p in self.split(low)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another as uint32, where each text's begin and end); null is the empty text."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        cut = lists.offsets.to_numpy()
        coded = lists.values.slice(cut[0], cut[-1] - cut[0]).dictionary_encode()
        get, new, ids = self.words.get, self.words.put, []
        for w in coded.dictionary.to_pylist():
            found = get(w)
            if found is None:
                found = self.word(w)
                new(w, found)
            ids.append(found)
        pool = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        each = size[which]
        end = np.concatenate(([0], np.cumsum(each)))
        flat = pool[np.repeat(begin[which] - end[:-1], each) + np.arange(end[-1])]
        return flat, end[cut - cut[0]]


def word_bpe(path: str) -> WordBpe:
    return kept(f"word_bpe {path}", lambda: WordBpe(path))
