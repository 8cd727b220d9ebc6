"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

The encoding of a string ends in exactly one token, and what stands before that token is the
encoding of the rest. So a string's state is its last token, and the state of a string comes from
those of its prefixes: the last token is the vocabulary suffix that is an encoding by itself and
stays apart from the last token of the prefix before it. Distinct words go into a trie; one
depth-first walk gives the state of every node, so prefixes that words share are encoded once.

The trie is kept as the sorted words: going through them is its depth-first walk, and a word's
common prefix with the one before it is the path to the node where it branches off. Only the states
of one path are held, so a word of many megabytes takes a few bytes per letter.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, word_ids

NO_LIMIT = 1 << 60
#: Words and pairs of tokens that a worker remembers: some 150 and 100 bytes each.
MAX_WORDS, MAX_PAIRS = 400_000, 300_000
#: Bytes of texts encoded at a time.
BLOCK = 4 << 20


class TrieBpe:
    """Encodes and decodes with a byte-level vocabulary file of the tokenizers library.

    The library's own pre-tokenizer cuts distinct words; merges and decoding are done here.
    """

    def __init__(self, vocabulary: str):
        with open(word_ids.vocabulary_path(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        self.cutter = word_ids.encoder(vocabulary)
        self.pre = self.cutter.library.pre_tokenizer
        self.ids: dict[str, int] = spec["model"]["vocab"]
        #: Lengths, from the longest, of the tokens of three and more letters that end in three certain letters.
        ends: dict[str, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.ends = {x: tuple(sorted(n, reverse=True)) for x, n in ends.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        size = max([*self.ids.values(), *self.added.values()]) + 1
        #: For each token the rank of the merge that makes it (single bytes: -1) and its two parts.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            i = self.ids[a + b]
            self.merge_rank[self.ids[a], self.ids[b]] = r
            self.rank[i], self.left[i], self.right[i] = r, self.ids[a], self.ids[b]
        self.text = [""] * size
        for t, i in self.ids.items():
            self.text[i] = t
        byte_of = {c: b for b, c in enumerate(word_ids.byte_letters())}
        self.raw = [bytes(byte_of[c] for c in t) for t in self.text]
        self.letters = dict(enumerate(word_ids.byte_letters()))
        for t, i in self.added.items():
            self.raw[i] = t.encode()
        #: By first token times size plus second.
        self.size, self.apart = size, {}
        self.whole: dict[int, bool] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of two tokens comes before those that make them.

        Merges are undone from the last: at each step the border pair is looked up, and its merge
        wins if it ranks before everything undone so far. Of equal ranks the left one came first.
        """
        key, limit, result = a * self.size + b, NO_LIMIT, True
        while True:
            r = self.merge_rank.get((a, b))
            if r is not None and r < limit:
                result = False
                break
            if self.rank[a] < 0 and self.rank[b] < 0:
                break
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            else:
                limit, b = self.rank[b] + 1, self.left[b]
        if len(self.apart) < MAX_PAIRS:
            self.apart[key] = result
        return result

    def is_whole(self, t: int) -> bool:
        """Whether a token's own text is encoded as that one token."""
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merged([self.ids[c] for c in self.text[t]]) == [t]
        return known

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging, lowest rank first, leftmost of equals: for single tokens only."""
        while len(ids) > 1:
            r, i = min((self.merge_rank.get((a, b), NO_LIMIT), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if r == NO_LIMIT:
                break
            ids = [*ids[:i], self.ids[self.text[ids[i]] + self.text[ids[i + 1]]], *ids[i + 2 :]]
        return ids

    def _fits(self, t: int, before: int) -> bool:
        """Whether a token can be the last one after another (-1: it is all there is)."""
        if before >= 0:
            ok = self.apart.get(before * self.size + t)
            if not (self.stays_apart(before, t) if ok is None else ok):
                return False
        known = self.whole.get(t)
        return self.is_whole(t) if known is None else known

    def _last(self, word: str, depth: int, states: list[int]) -> int:
        """State of a word's prefix of that length, from those of the shorter ones: the longest token that fits."""
        ids, fits = self.ids, self._fits
        for n in self.ends.get(word[max(0, depth - 3) : depth], ()):
            if n <= depth:
                t = ids.get(word[depth - n : depth])
                if t is not None and fits(t, states[depth - n]):
                    return t
        for n in (2, 1):
            if n <= depth:
                t = ids.get(word[depth - n : depth])
                if t is not None and fits(t, states[depth - n]):
                    return t
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, spelled in the vocabulary's letters, by one walk through their trie."""
        out: dict[str, list[int]] = {}
        states, before, last = [-1], "", self._last
        for word in sorted(words):
            depth = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                depth += 1
            del states[depth + 1 :]
            for d in range(depth + 1, len(word) + 1):
                states.append(last(word, d, states))
            ids, at = [], len(word)
            while at:
                ids.append(states[at])
                at -= len(self.text[states[at]])
            out[word], before = ids[::-1], word
        return out

    def _plain(self, texts: list[str]) -> list[list[int]]:
        """Ids of stretches without added tokens: pre-tokens through one trie."""
        cut = [[w for w, _ in self.pre.pre_tokenize_str(t)] if not word_ids.LATIN(t[1:]) or t[0] != " " else [t.encode().decode("latin-1").translate(self.letters)] for t in texts]
        found = self.encode_words({w for words in cut for w in words})
        return [[i for w in words for i in found[w]] for words in cut]

    def _stretches(self, text: str) -> list[str]:
        """A text cut at added tokens, which stand at the odd places."""
        if not self.added:
            return [text]
        return re.split(f"({'|'.join(map(re.escape, self.added))})", text)

    def _whole_texts(self, texts: list[str]) -> list[list[int]]:
        out = []
        for parts in map(self._stretches, texts):
            plain = iter(self._plain(parts[::2]))
            out.append([i for k, p in enumerate(parts) for i in ([self.added[p]] if k % 2 else next(plain))])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of whole UTF-8 texts; null: none."""
        cut = [self.cutter.cut(t) if t else [] for t in texts]
        known, extra = self.words, {}
        missing = list({w for words in cut if words for w in words if w not in known})
        if missing:
            for w, ids in zip(missing, self._plain([self.cutter.spelled(w).decode() for w in missing]), strict=True):
                keep = known if len(known) < MAX_WORDS and len(w) <= word_ids.MAX_WORD_BYTES else extra
                keep[w] = array("I", ids).tobytes()
        at = (lambda w: extra[w] if w in extra else known[w]) if extra else known.__getitem__
        return [array("I", self._whole_texts([texts[i].decode()])[0]).tobytes() if words is None else b"".join(map(at, words)) for i, words in enumerate(cut)]


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> TrieBpe:
    return TrieBpe(vocabulary)


def _each_block(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], TrieBpe]]:
    """Keys and packed ids, about BLOCK bytes of texts at a time."""
    tool = codec(vocabulary)
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for start, end in word_ids.batches(texts, BLOCK):
            yield batch["key"].slice(start, end - start), tool.encode(texts.slice(start, end - start).to_pylist()), tool


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows, rows.schema["key"].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids (packed, unsigned 32 bits) of every whole text. No shuffle.

    Null and empty texts have no ids. Every row gives one row, also where keys are null or repeated;
    an empty table gives none. Words of any length are encoded whole. Other columns aren't read.
    """
    rows, kind = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, _ in _each_block(vocabulary, batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary())], names=["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids binary")


def decode_array(vocabulary: str):
    """Arrow function: texts of packed ids."""

    def run(ids: pa.Array) -> pa.Array:
        tool = codec(vocabulary)
        return pa.array([None if x is None else tool.decode(array("I", x)) for x in ids.to_pylist()], pa.string())

    return run


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Number and hash of the ids of every text, and hash of what they decode to; rows as with encode.

    Both are done in one pass, so a task has one Python worker and one copy of the vocabulary.
    """
    rows, kind = _rows(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for keys, ids, tool in _each_block(vocabulary, batches):
            decoded = [sha(tool.decode(array("I", x)).encode()) for x in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
