"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per worker.

A byte-pair tokenizer never merges across its pre-tokens, so a text's ids are those of its words in
a row. A worker cuts texts at blanks, asks the library for words it hasn't met, and joins the packed
ids. A text where blanks alone don't show the pre-tokens goes through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and runs of signs that a worker remembers, and the longest of them; others are encoded again when they come again.
MAX_WORDS, MAX_SIGNS, MAX_WORD_BYTES = 690_000, 10_000, 48

#: Whitespace other than blank and line feed, in UTF-8: in ASCII, and lead bytes and patterns of the rest.
_ASCII_SPACE = b"\t\v\f\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe1\xa0", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")

#: Words of Latin letters alone, which no pre-tokenizer cuts; those with ASCII signs after them, which
#: every one parts from the letters; and some words to try on a vocabulary.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
LATIN = re.compile(_LETTERS).fullmatch
SIGNED = re.compile(rf"({_LETTERS})([!-/:-@\[-`{{-~]*)").fullmatch
PROBES = ["a", "Word", "Straße", "ÉTÉ", "übergrößenträger", "llll", "ſŒŁ", "Word,", "a.", "Çe?", "x$$$", "so.***", "it')", "a_-"]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable Latin-1 characters
    stand for themselves, the others get letters from U+0100 on in ascending order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file is; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Packed ids by word; those of a new word are made when it is asked for, and stay if there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if len(self) < MAX_WORDS and len(word) <= MAX_WORD_BYTES:
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes UTF-8 texts to packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        #: The kind of pre-tokenizer says how texts may be cut.
        self.keeps_blanks = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None
        self.known = _Known(self.word)
        self.model, self.normalizer, self.table = self.library.model, self.library.normalizer, dict(enumerate(byte_letters()))
        self.head = self.table[0x20] if self.keeps_blanks else ""
        self.line_feed = self.whole(b"\n")
        self.signs: dict[str, bytes] = {}
        #: Whether words of letters may go to the model at once, past normalizer and pre-tokenizer.
        self.direct = False
        shapes = [*PROBES, *(x + w for w in PROBES for x in ("\n", "\n\n") if self.keeps_blanks)]
        self.direct = all(self.letters(w.encode()) == self.whole(self.spelled(w.encode())) for w in shapes)

    def whole(self, text: bytes) -> bytes:
        return array("I", self.library.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _odd(self, text: bytes) -> bool:
        """Whether blanks and line feeds alone don't show the pre-tokens."""
        if len(text.translate(None, _ASCII_SPACE)) != len(text) or any(t in text for t in self.added):
            return True
        return not text.isascii() and any(x in text for x in _LEADS) and _OTHER_SPACE.search(text) is not None

    def cut(self, text: bytes) -> list[bytes] | None:
        """Words of a text, or None if it has to be encoded whole.

        Word-end vocabularies drop whitespace: any ASCII whitespace parts two words. Byte-level ones
        join one blank to the word after it, so a word stands for itself with a blank before it, and
        one that begins with a line feed for itself alone.
        """
        if not self.keeps_blanks:
            return text.split()
        if self._odd(text):
            return None
        words = text.replace(b"\n", b" \n").split(b" ")
        if b"" in words or b"\n" in words:
            return None
        words[0] = b"\n\n" + words[0]
        return words

    def spelled(self, word: bytes) -> bytes:
        if not self.keeps_blanks:
            return word
        return word[2:] if word[:2] == b"\n\n" else word if word[:1] == b"\n" else b" " + word

    def letters(self, word: bytes) -> bytes | None:
        """Packed ids, from the library's model, of a word of Latin letters, with signs after them or not; else None."""
        lead, head, body = b"", self.head, word
        if self.keeps_blanks and word[:1] == b"\n":
            head = ""
            lead, body = (b"", word[2:]) if word[1:2] == b"\n" else (self.line_feed, word[1:])
        text = body.decode()
        if self.normalizer is not None:
            text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
        found = SIGNED(text)
        if found is None:
            return None
        text, signs = found.groups()
        tail = b""
        if signs:
            if any(t in word for t in self.added):
                return None
            tail = self.signs.get(signs)
            if tail is None:
                tail = self.whole(signs.encode())
                if len(self.signs) < MAX_SIGNS and len(signs) <= MAX_WORD_BYTES:
                    self.signs[signs] = tail
            known = self.known.get(word[: -len(signs)])
            if known is not None:
                return known + tail
        spelling = head + (text if text.isascii() else text.encode().decode("latin-1").translate(self.table))
        return lead + array("I", [x.id for x in self.model.tokenize(spelling)]).tobytes() + tail

    def word(self, word: bytes) -> bytes:
        """Packed ids of a word as cut() gives it."""
        ids = self.letters(word) if self.direct else None
        return self.whole(self.spelled(word)) if ids is None else ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of each text; null and empty texts have none."""
        at = self.known.__getitem__
        return [self.whole(t) if (words := self.cut(t) if t else []) is None else b"".join(map(at, words)) for t in texts]


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    return WordEncoder(vocabulary)


def batches(column, most: int = 1 << 20):
    """Runs (start, end) of an Arrow binary column with about that many bytes each."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)
