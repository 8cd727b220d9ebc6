"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams says on
which side a text is. A text gets the language whose codeword has the least weighted exponential
loss, where a bit weighs for a language as much as it was right on the labelled rows. If the
best two losses are close, the text is flagged as ambiguous.

Learning is two passes over all labelled rows: one sums n-gram counts per language, the other sums
for each bit how large its margins are and how often it is right. All languages are learnt. Of more than
FEW, the counts stay a table, which the bits' classifiers are summed from; codewords are packed bits then, some
BITS_FOR_DOUBLE for each doubling of the number of languages, and a bit weighs the same for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, word_ids

UNKNOWN = "und"
#: Hash buckets, longest n-gram in bytes, smoothing.
BUCKETS, LONGEST, SMOOTHING = 1 << 13, 3, 0.5
#: Languages whose counts the driver holds, BUCKETS numbers for each; of more it holds names and packed codewords.
FEW, BITS_FOR_DOUBLE = 500, 32
#: Bytes of a long text, and losses, that are looked at in one go.
BLOCK, MAX_LOSSES = 1 << 20, 1 << 20
#: Margins are summed as whole multiples of 1 / MARGIN_UNIT, so that the sum doesn't depend on the order of rows.
MARGIN_UNIT = 1 << 24
#: Margin of a text halfway sure, in units of a bit's mean margin; share by which the second best loss has to be larger.
SHARPNESS, AMBIGUITY = 3.0, 0.1
MIX = np.uint32(0x9E3779B1)


def codewords(n: int) -> np.ndarray:
    """n distinct rows of -1 and 1: exhaustive for a few languages, else of a Hadamard matrix.

    The least distance of two rows is about half their length, so that wrong bits can be outvoted.
    """
    if n <= 6:
        bits = 2 ** max(n - 1, 0) - 1
        rows = [[1] * bits]
        for r in range(1, n):
            run = 2 ** (n - 1 - r)
            rows.append([1 if (j // run) % 2 else -1 for j in range(bits)])
        return np.array(rows[:n], dtype=np.float32).reshape(n, bits)
    m = np.ones((1, 1), dtype=np.float32)
    while len(m) < 2 * n:
        m = np.block([[m, m], [m, -m]])
    m = m[:n]
    return m[:, np.abs(m.sum(axis=0)) < n]


def packed_codewords(n: int) -> np.ndarray:
    """n rows of packed bits that look random: any two differ in about half of them."""
    words = -(-BITS_FOR_DOUBLE * max(1, n - 1).bit_length() // 64)
    x = (np.arange(n * words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.uint8).reshape(n, 8 * words)


def _long_counts(text: bytes) -> np.ndarray:
    """As counts, of one text, in blocks that overlap by what an n-gram needs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), BLOCK):
        flat = np.frombuffer(text[at : at + BLOCK + LONGEST - 1], dtype=np.uint8).astype(np.uint32)
        grams = np.zeros_like(flat)
        for n in range(1, LONGEST + 1):
            grams = (grams[: len(flat) - n + 1] << np.uint32(8)) | flat[n - 1 :] if len(flat) >= n else flat[:0]
            # Those that begin in the block.
            total += np.bincount(((grams[:BLOCK] + np.uint32(n)) * MIX) >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def counts(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """Counts of the hashed n-grams of each whole text of an Arrow binary column; null: None."""
    for start, end in word_ids.batches(texts):
        part = texts.slice(start, end - start)
        if end == start + 1 and part[0].is_valid and len(part[0].as_buffer()) > BLOCK:
            yield _long_counts(part[0].as_py())
            continue
        flat = np.frombuffer(b"".join(x or b"" for x in part.to_pylist()), dtype=np.uint8).astype(np.uint32)
        grams, hashes = np.zeros_like(flat), []
        for n in range(1, LONGEST + 1):
            grams = (grams[: len(flat) - n + 1] << np.uint32(8)) | flat[n - 1 :] if len(flat) >= n else flat[:0]
            hashes.append(((grams + np.uint32(n)) * MIX) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        lengths = pc.binary_length(part)
        at = 0
        for size in lengths.to_pylist():
            if size is None:
                yield None
                continue
            total = np.zeros(BUCKETS, dtype=np.int64)
            for n, h in enumerate(hashes, 1):
                if size >= n:
                    total += np.bincount(h[at : at + size - n + 1], minlength=BUCKETS)
            at += size
            yield total


@dataclass
class Model:
    languages: list[str]
    #: Rows of -1 and 1, or of packed bits.
    codes: np.ndarray
    weights: np.ndarray
    scales: np.ndarray
    trust: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Rows: texts; columns: the margin of each bit's classifier, in units of its mean margin."""
        found = [np.zeros(BUCKETS, np.float32) if c is None else c.astype(np.float32) / max(1, c.sum()) for c in counts(texts)]
        out = np.zeros((len(found), self.weights.shape[1]), dtype=np.float64)
        for i in range(0, len(found), 256):
            out[i : i + 256] = np.stack(found[i : i + 256]) @ self.weights
        return out / self.scales

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each language's codeword for each text."""
        if self.codes.dtype == np.uint8:
            low, high = (np.exp(np.clip(sign * SHARPNESS * margins, -20, 20)) * self.trust for sign in (1, -1))
            out = np.empty((len(margins), len(self.codes)))
            for at in range(0, len(self.codes), 4_096):
                out[:, at : at + 4_096] = (high - low) @ np.unpackbits(self.codes[at : at + 4_096], axis=1).T.astype(np.float64)
            return out + low.sum(axis=1, keepdims=True)
        wrong = np.exp(np.clip(-SHARPNESS * margins[:, None, :] * self.codes[None], -20, 20))
        return (wrong * self.trust[None]).sum(axis=2)

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score from 0 to 1 and ambiguity of each text."""
        n = len(texts)
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        best, score, ambiguous = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
        step = min(256, max(1, MAX_LOSSES // len(self.languages)))
        for i in range(0, n, step):
            losses = self.losses(self.margins(texts.slice(i, step)))
            two = np.sort(np.partition(losses, 1, axis=1)[:, :2], axis=1)
            share = np.exp(-np.minimum(losses - two[:, :1], 50))
            best[i : i + step], score[i : i + step] = losses.argmin(axis=1), 1 / share.sum(axis=1)
            ambiguous[i : i + step] = two[:, 1] - two[:, 0] < AMBIGUITY * two[:, 1]
        return best, score, ambiguous


def _text(text: str) -> Column:
    return F.lower(F.col(text).cast("string"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from all rows with a text and a language; None if there are none. Repeated rows count each time."""
    spark = common.ready(labelled.sparkSession)
    rows = labelled.select(_text(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, c in zip(batch["lang"].to_pylist(), counts(batch["text"].cast(pa.binary())), strict=True):
                if name in total:
                    total[name] += c
                else:
                    total[name] = c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    summed = rows.mapInArrow(sums, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = common.kept(summed, common.shared_folder(spark, "languages") + "/counts")
    languages = [r.lang for r in summed.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None
    if len(languages) > FEW:
        codes = packed_codewords(len(languages))
        weights = _summed_weights(summed, languages, codes)
        bits = weights.shape[1]
        model = Model(languages, codes, weights, np.ones(bits), np.full((1, bits), 1 / bits))
    else:
        codes = codewords(len(languages))
        bits = codes.shape[1]
        model = Model(languages, codes, _held_weights(summed, languages, codes), np.ones(bits), np.full(codes.shape, 1 / max(bits, 1)))
    if bits:
        _calibrate(model, rows)
    return model


def _logs(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    return (np.log(positive + 1e-9) - np.log(negative + 1e-9)).astype(np.float32)


def _held_weights(summed: DataFrame, languages: list[str], codes: np.ndarray) -> np.ndarray:
    """Weights (bucket, bit) of the classifiers, from one vector of BUCKETS counts for each language."""
    vectors = {r.lang: r for r in summed.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).collect()}
    share = np.full((len(languages), BUCKETS), SMOOTHING)
    for i, name in enumerate(languages):
        share[i, vectors[name].at] += vectors[name].n
    share /= share.sum(axis=1, keepdims=True)
    positive = (codes > 0).astype(float)
    side = lambda m: (m.T @ share) / np.maximum(m.sum(axis=0), 1)[:, None]
    return _logs(side(positive), side(1 - positive)).T


def _summed_weights(summed: DataFrame, languages: list[str], codes: np.ndarray) -> np.ndarray:
    """The same from the table of counts: each bucket's shares are summed by bit where the bucket is, language by language."""
    spark = summed.sparkSession
    numbers = spark.createDataFrame(pa.table({"lang": pa.array(languages, pa.string()), "i": pa.array(range(len(languages)), pa.int32())}))
    totals = summed.groupBy("lang").agg((F.sum("n") + SMOOTHING * BUCKETS).alias("total")).join(numbers, "lang")
    shares = summed.join(totals, "lang").select("bucket", "i", (F.col("n") / F.col("total")).alias("share"))
    shared = spark.sparkContext.broadcast(codes)
    bits = 8 * codes.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, every = None, np.zeros(bits), 0.0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([every])], names=["bucket", "positive", "every"])

        for batch in batches:
            buckets, lang, share = (batch[c].to_numpy() for c in ("bucket", "i", "share"))
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(buckets)], strict=True):
                if low == high:
                    continue
                if buckets[low] != at:
                    if at is not None:
                        yield done()
                    at, total, every = int(buckets[low]), np.zeros(bits), 0.0
                for k in range(low, high, 4_096):
                    part = slice(k, min(k + 4_096, high))
                    total += share[part] @ np.unpackbits(shared.value[lang[part]], axis=1)
                    every += share[part].sum()
        if at is not None:
            yield done()

    placed = shares.repartition(common.partitions(spark), "bucket").sortWithinPartitions("bucket", "i")
    # What smoothing gives a language's every bucket.
    base = totals.orderBy("i").select("i", (SMOOTHING / F.col("total")).alias("base")).toArrow()["base"].to_numpy()
    ones = np.zeros(bits)
    smooth = np.zeros(bits)
    for k in range(0, len(codes), 4_096):
        unpacked = np.unpackbits(codes[k : k + 4_096], axis=1)
        ones += unpacked.sum(axis=0)
        smooth += base[k : k + 4_096] @ unpacked
    positive, every = np.tile(smooth, (BUCKETS, 1)), np.full(BUCKETS, base.sum())
    # One row for each of BUCKETS.
    for r in placed.mapInArrow(sums, "bucket int, positive array<double>, every double").toLocalIterator():
        positive[r.bucket] += r.positive
        every[r.bucket] += r.every
    return _logs(positive / np.maximum(ones, 1), (every[:, None] - positive) / np.maximum(len(codes) - ones, 1))


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Scale of each bit, and its weight for each language (or for all, with packed codewords), from all rows; only sums leave the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    packed = model.codes.dtype == np.uint8

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = {name: i for i, name in enumerate(m.languages)}
        shape = m.trust.shape
        seen, size, right = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            texts, names = batch["text"].cast(pa.binary()), batch["lang"].to_pylist()
            for low in range(0, len(texts), 256):
                margins = m.margins(texts.slice(low, 256))
                # A language whose texts are all empty isn't in the model.
                here = np.array([at.get(x, -1) for x in names[low : low + 256]])
                for i in np.unique(here[here >= 0]):
                    mine = margins[here == i]
                    row, code = (0, np.unpackbits(m.codes[i]) > 0) if packed else (i, m.codes[i] > 0)
                    seen[row] += len(mine)
                    size[row] += np.rint(np.abs(mine) * MARGIN_UNIT).astype(np.int64).sum(axis=0)
                    right[row] += ((mine > 0) == code).sum(axis=0)
        lang, bit = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bit.astype(np.int32)), *(pa.array(x[lang, bit]) for x in (seen, size, right))], names=["lang", "bit", "n", "size", "good"])

    summed = rows.mapInArrow(sums, "lang int, bit int, n long, size long, good long").groupBy("lang", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "size", "good")])
    shape = model.trust.shape
    n, size, right = np.zeros(shape), np.zeros(shape), np.ones(shape)
    # One row for each bit, and for each language where there are few.
    for r in summed.collect():
        n[r.lang, r.bit], size[r.lang, r.bit], right[r.lang, r.bit] = r.n, r["size"], r.good / r.n
    model.scales = np.maximum(size.sum(axis=0) / MARGIN_UNIT / np.maximum(n.sum(axis=0), 1), 1e-9)
    right = np.where(right > 0.5, right, 1e-3)
    model.trust = right / right.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """Add a struct column (lang, score, ambiguous) for every whole text; no shuffle.

    Texts that are null, empty or without a letter, and all texts if nothing was learnt, get
    UNKNOWN with score 0. Other columns pass through; one named as the new column is replaced.
    """
    spark = common.ready(docs.sparkSession)
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if model is None:
        return docs.withColumn(into, nothing)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    @F.arrow_udf("lang string, score double, ambiguous boolean")
    def decide(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, score, ambiguous = m.decide(texts.cast(pa.binary()))
        return pa.StructArray.from_arrays([pa.array([m.languages[i] for i in best], pa.string()), pa.array(score), pa.array(ambiguous)], names=["lang", "score", "ambiguous"])

    letters = F.col(text).cast("string").rlike(r"\p{L}")
    found = decide(F.when(letters, _text(text)))
    return docs.withColumn(into, F.when(F.coalesce(letters, F.lit(False)), found).otherwise(nothing))


def held_out(key: Column) -> Column:
    """Rows that learning may not use: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame) -> Model | None:
    """Learn from documents with an id that aren't held out."""
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, repeated ones too; an empty table gives none.

    Texts of any length are read whole; columns other than doc_id, text and lang aren't read.
    """
    found = predict(docs.select("doc_id", "text"), fit_on(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is known and not ambiguous, with their own columns."""
    name = common.free_name(docs, "_language")
    found = predict(docs, fit_on(docs), into=name)
    return found.where((F.col(f"{name}.lang") != UNKNOWN) & ~F.col(f"{name}.ambiguous")).select(*[F.col(f"`{c}`") for c in docs.columns])
