import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyleaf.llm import common, packing, token_files, trie_bpe, word_ids

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = ["a", "the", " ", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "é", "ß", "中文", "🙂", " ", "\x1c", "\r\n", "<|endoftext|>", "aaaa", "!!", "--", "é", "Σ", "İ", "\x00", "​"]
SCHEMA = "doc_id long, text string, key string, bucket int, lang string"


def texts(n=120, seed=1):
    r = random.Random(seed)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)]
    return [*out, None, "", "x" * 3000, "word and " * 4000]


def table(spark, values):
    """With columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "k", -1, "l") for i, t in enumerate(values)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {v: Tokenizer.from_file(word_ids.vocabulary_path(v)) for v in (BYTE, WORD)}


def ids_of(library, vocabulary, text):
    return library[vocabulary].encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("vocabulary", [BYTE, WORD])
def test_words_give_the_ids_of_whole_texts(library, vocabulary):
    values = texts(2000, seed=7)
    got = word_ids.WordEncoder(vocabulary).encode([None if t is None else t.encode() for t in values])
    assert got == [packed(ids_of(library, vocabulary, t)) for t in values]


def test_trie_against_the_library(library):
    tool = trie_bpe.TrieBpe(BYTE)
    values = texts(2000, seed=8)
    got = tool.encode([None if t is None else t.encode() for t in values])
    assert got == [packed(ids_of(library, BYTE, t)) for t in values]
    r = random.Random(2)
    for _ in range(300):  # any ids, also such that aren't UTF-8 together
        ids = [r.randrange(50257) for _ in range(r.randint(0, 10))]
        assert tool.decode(ids) == library[BYTE].decode(ids, skip_special_tokens=False)


def test_words_of_megabytes(library):
    """A word of 5 MB takes the states of one path: some bytes a letter, and seconds."""
    r = random.Random(6)
    tool, began = trie_bpe.codec(BYTE), time.process_time()
    words = ["a" * 5_000_000, "".join(r.choice("etaoinshr") for _ in range(1_000_000)), "中文" * 100_000]
    got = tool.encode([w.encode() for w in words])
    assert time.process_time() - began < 120
    assert got == [packed(ids_of(library, BYTE, w)) for w in words]
    assert not any(len(w) > word_ids.MAX_WORD_BYTES for w in tool.words)
    for vocabulary in (BYTE, WORD):
        assert word_ids.encoder(vocabulary).encode([words[1].encode()]) == [packed(ids_of(library, vocabulary, words[1]))]


@pytest.mark.parametrize("vocabulary", [BYTE, WORD])
def test_words_with_signs_and_line_feeds(library, vocabulary):
    r = random.Random(16)
    parts = ["a", "The", "É", "don't", "12", ")", ",", ".", "!", "!!", "?", ":", " ", " ", " ", "\n", "x,", "foo.\n", "ſ"]
    values = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    got = word_ids.WordEncoder(vocabulary).encode([t.encode() for t in values])
    assert got == [packed(ids_of(library, vocabulary, t)) for t in values]


def test_round_trip_rows(spark, library):
    values = texts()
    rows = {r.doc_id: r for r in trie_bpe.round_trip(table(spark, values), BYTE).collect()}
    for i, t in enumerate(values):
        ids = ids_of(library, BYTE, t)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256(library[BYTE].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert trie_bpe.round_trip(table(spark, []), BYTE).count() == 0
    twice = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (5, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in trie_bpe.round_trip(twice, BYTE).collect()) == [("5", 0), ("5", 2), ("5", 2), ("None", 2)]


def test_token_files(spark, library, tmp_path):
    values = texts()
    folder = f"file://{tmp_path}/tokens"
    got = token_files.digest_rows(table(spark, values), folder, BYTE, 2).collect()
    start = 0
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), values, strict=True):
        ids = [*ids_of(library, BYTE, t), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert token_files.read_document(spark, folder, 5) == [[*ids_of(library, BYTE, values[5]), 2]]
    shard = next(p for p in (tmp_path / "tokens").iterdir() if p.name.startswith("shard"))
    assert (tmp_path / "tokens/dictionary").stat().st_size > 0
    shard.write_bytes(shard.read_bytes()[:-1])
    with pytest.raises(Exception, match="not a token shard"):
        token_files.read(spark, folder).collect()
    with pytest.raises(ValueError):
        token_files._checked(b"other", hashlib.sha256(b"").digest())


def test_token_files_order_of_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(None, "b"), (3, "z"), (3, "a"), (3, "a"), (-1, None), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    token_files.write(docs, folder, BYTE, 2)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, None, -1, 3, 3, 3]
    assert [r.n_tokens for r in got] == [2, 2, 1, 2, 2, 2] and got[3].ids == got[4].ids != got[5].ids
    empty = f"file://{tmp_path}/e"
    assert token_files.write(docs.limit(0), empty, BYTE, 2).count() == 0 and token_files.read(spark, empty).count() == 0


def test_a_common_key_is_dealt_to_several_shards(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(60)] + [(None, f"none {i}") for i in range(60)] + [(i, "x") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"file://{tmp_path}/t"
    made = [r.docs for r in token_files.write(docs.withColumn("shard", F.lit(1)), folder, BYTE, 2).collect()]
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None] * 60 + [7] * 60 + list(range(100, 160)) and sum(made) == 180
    keys = pa.array([None] * 300 + [5] * 300 + [9], pa.int64())
    place = common.dealt_buckets(keys, np.array([common.SMALLEST, common.SMALLEST, 5, 5, 5]), [str(i).encode() for i in range(601)])
    assert set(place[:300]) == {1, 2} and set(place[300:600]) == {3, 4, 5} and place[600] == 5


def test_packing(spark, library):
    values = [*texts(), "word " * 500, "word " * 500]
    got = packing.pack(table(spark, values), WORD, 0, 256, with_ids=True).collect()
    by_piece = {(r.key, r.piece): r for r in got}
    pieces = 0
    for i, t in enumerate(values):
        ids = [*ids_of(library, WORD, t), 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            r, part = by_piece[i, p], ids[at : at + 256]
            assert (r.start, r.length, bytes(r.ids), r.ids_crc32) == (at, len(part), packed(part), zlib.crc32(packed(part)))
            pieces += 1
    assert pieces == len(got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.pack(table(spark, []), WORD, 0, 256).count() == 0


def test_merging_bins_in_several_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    r = random.Random(4)
    sizes = [(i, r.randint(1, 99)) for i in range(150)]
    moved = packing.merge_bins(spark.createDataFrame(sizes, "bin long, fill long"), 100, f"file://{tmp_path}").collect()
    fill, places = dict(sizes), {}
    for m in moved:
        places.setdefault(m.sequence, []).append((m.shift, fill[m.bin]))
    assert sorted(m.bin for m in moved) == list(range(150))
    for parts in places.values():
        at = 0
        for shift, size in sorted(parts):
            assert shift == at
            at += size
        assert at <= 100


@pytest.mark.parametrize("fulls", [20, 200])
def test_no_two_bins_that_fit_together_stay_apart(spark, tmp_path, monkeypatch, fulls):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 10)
    sizes = dict(enumerate([80] * fulls + [60] * 15 + [40] * 15))
    moved = packing.merge_bins(spark.createDataFrame(list(sizes.items()), "bin long, fill long"), 100, f"file://{tmp_path}").collect()
    assert sorted(m.bin for m in moved) == list(sizes)
    places = {}
    for m in moved:
        places.setdefault(m.sequence, []).append((m.shift, sizes[m.bin]))
    for parts in places.values():
        parts.sort()
        assert [shift for shift, _ in parts] == [sum(size for _, size in parts[:i]) for i in range(len(parts))]
    least = sorted(sum(size for _, size in parts) for parts in places.values())
    assert least[0] + least[1] > 100 and least[-1] <= 100


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fill = packing.best_fit([5, 9, 4, 1, 10], 10)
    assert fill == [10, 9, 10] and bins == [2, 1, 2, 2, 0] and offsets == [0, 0, 5, 9, 0]
