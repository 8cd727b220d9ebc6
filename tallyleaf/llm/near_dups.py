"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text becomes the set of its word shingles, hashed once; the sketch is the k smallest
   hashes. Texts with equal sets make one class, which its smallest id stands for.
2. Inverted lists of retained values give candidates. Two sets as similar as the threshold share
   at least REQUIRED of their retained values (but for odds below 1e-5), so it is enough to list a
   class under its rarest values, all but REQUIRED - 1 of them: values of passages that many
   texts share come last and make no lists.
3. In each list every class meets the list's pivot, the one whose retained values are the most
   common; a union sketch, the k smallest of both, estimates the similarity and filters; exact
   Jaccard of the full sets decides. Classes linked to one pivot are connected, so their pairs
   need not be looked at.
4. What is left are lists whose members aren't all connected. Their full sets are put in order from
   the rarest shingle; a similar pair has its first common shingle so early in both that enough others
   can follow. Under each such shingle all meet one pivot first, as above; then pairs that are still in
   different components meet, if parity marks of their sets allow so small a difference. Exact
   Jaccard decides again.
5. Connected components of the links, by large-star and small-star steps.

With ``retained=None`` all hashes are retained: then steps 2 to 4 miss no pair at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, word_ids

#: Sketch size; retained values that two similar sets surely share; an estimate below this share of the threshold drops a pair (five standard errors).
K, REQUIRED, ESTIMATE_SLACK = 48, 24, 0.6
#: 64-bit words of a set's parity marks.
MARK_WORDS = 16
RADIX, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of a long text that are looked at in one go; all bits of a hash.
BLOCK, _ALL = 1 << 20, (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, RADIX))


def _word_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Polynomials and lengths of the words of a stretch of bytes, and whether it begins and ends inside a word."""
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, False, False
    lengths = ends - starts
    # Places within the word, counted from its end, so that equal words have equal sums.
    place = np.repeat(ends, lengths) - np.arange(lengths.sum()) - np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) - 1
    letters = raw[~_SPACE[raw]].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * _powers(int(lengths.max()) + 1)[place], np.cumsum(lengths) - lengths)
    return sums, lengths, bool(inside[1]), bool(inside[-2])


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of a UTF-8 text, A-Z in lower case: a polynomial of its bytes, mixed with its length.

    A long text is read in blocks; a word that lies across their edges is put together from its parts.
    """
    if len(text) <= BLOCK:
        sums, lengths, _, _ = _word_sums(_LOWER[np.frombuffer(text, dtype=np.uint8)])
        return _mixed(sums + lengths.astype(np.uint64))
    out: list[np.ndarray] = []
    open_sum, open_length = 0, 0
    for at in range(0, len(text), BLOCK):
        sums, lengths, begins, ends = _word_sums(_LOWER[np.frombuffer(text[at : at + BLOCK], dtype=np.uint8)])
        if open_length and not begins:
            out.append(_mixed(np.array([open_sum + open_length & _ALL], dtype=np.uint64)))
            open_sum = open_length = 0
        if open_length:
            # R to the power of the part's length moves the part before it up.
            sums[0] = np.uint64((open_sum * pow(int(RADIX), int(lengths[0]), 1 << 64) + int(sums[0])) & _ALL)
            lengths[0] += open_length
            open_sum = open_length = 0
        if ends:
            open_sum, open_length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(_mixed(sums + lengths.astype(np.uint64)))
    if open_length:
        out.append(_mixed(np.array([open_sum + open_length & _ALL], dtype=np.uint64)))
    return np.concatenate(out)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles of ``size`` words, A-Z in lower case.

    With fewer words, that of the whole sequence; with none, no hashes.
    """
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(words))):
        total = _mixed(total * RADIX + words[i : i + n])
    return np.unique((total + np.uint64(len(words) < size)).view(np.int64))


def _set_column(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    return [shingle_hashes(t, size) if t else np.zeros(0, dtype=np.int64) for t in texts]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text", retained: int | None = K) -> DataFrame:
    """Key, n_shingles, set_id (hash of the whole set; null if empty) and sketch (the smallest hashes) of every whole text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for start, end in word_ids.batches(texts):
                sets = _set_column(texts.slice(start, end - start).to_pylist(), size)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch["key"].slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), _lists([s[:retained] for s in sets])], names=["key", "n_shingles", "set_id", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_shingles long, set_id binary, sketch array<bigint>")


def parity_marks(hashes: np.ndarray) -> np.ndarray:
    """A bit for each residue: whether an odd number of a set's hashes has it.

    One more or one less hash flips one bit, so two sets differ in at least as many hashes as their marks in bits.
    """
    bits = np.bincount(hashes.view(np.uint64) % np.uint64(64 * MARK_WORDS), minlength=64 * MARK_WORDS).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def full_sets(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, set_id, all shingle hashes and parity marks of every whole text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for start, end in word_ids.batches(texts):
                sets = _set_column(texts.slice(start, end - start).to_pylist(), size)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch["key"].slice(start, end - start), pa.array(ids, pa.binary()), _lists(sets), _lists(list(map(parity_marks, sets)))], names=["key", "set_id", "shingles", "marks"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, set_id binary, shingles array<bigint>, marks array<bigint>")


def union_sketch_estimate(a: Column, b: Column, retained: int | None = K) -> Column:
    """Share of the smallest hashes of both sets, as many as are retained, that are in both."""
    every = F.array_sort(F.array_union(a, b))
    smallest = every if retained is None else F.slice(every, 1, retained)
    return common.let(smallest, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def postings(classes: DataFrame, percent: int, folder: str, retained: int | None = K) -> DataFrame:
    """Rows (value, rep, n, central): the lists under which a class has to be looked for, where others are too.

    The order of values is by number of classes, then by value; it is the same for all classes.
    ``central`` is larger the more common a class's values are. The numbers are written first, so that
    Spark can split the join's part for a very common value.
    """
    each = classes.select("rep", "n", F.explode("sketch").alias("value"))
    counts = common.kept(each.groupBy("value").agg(F.count("*").alias("classes")).where("classes > 1"), f"{folder}/counts")
    counted = each.join(counts, "value", "left").select("rep", "n", F.struct(F.coalesce("classes", F.lit(1)).alias("classes"), "value").alias("v"))
    grouped = counted.groupBy("rep", "n").agg(F.array_sort(F.collect_list("v")).alias("v"), F.avg(F.log("v.classes")).alias("central"))
    shared = F.ceil(F.col("n") * percent / 100)
    required = (shared if retained is None else F.least(shared, F.lit(REQUIRED))).cast("int")
    listed = grouped.select("rep", "n", "central", F.explode(F.slice("v", F.lit(1), F.size("v") - required + 1)).alias("v"))
    return listed.where("v.classes > 1").select("v.value", "rep", "n", "central")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"{c}_sketch"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of shared shingles and of all."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.select("a", "b", shared.alias("shared"), (F.size("a_set") + F.size("b_set") - shared).alias("all"))


def early_places(members: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """Rows (value, rep, n, alone, place, mark words) of the members' shingles that come early enough for a similar set.

    Shingles that one member has alone come first in every order and meet nothing, so they are only
    counted; the others are ranked by number of members, then by value.
    """
    mine = sets.join(members.withColumnRenamed("rep", "key"), "key").select(F.col("key").alias("rep"), "shingles", "marks")
    each = mine.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    counts = common.kept(each.groupBy("value").agg(F.count("*").alias("times")).where("times > 1"), f"{folder}/times")
    shared = each.join(counts, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("v"))
    alone = F.col("n") - F.size("v")
    latest = F.col("n") - F.ceil(F.col("n") * percent / 100)
    early = F.slice("v", F.lit(1), F.greatest(F.lit(0), latest - alone + 1).cast("int"))
    placed = shared.select("rep", "n", alone.alias("alone"), F.posexplode(early).alias("i", "v"))
    words = [F.col("marks")[i].alias(f"m{i}") for i in range(MARK_WORDS)]
    return placed.join(mine.select("rep", *words), "rep").select(F.col("v.value").alias("value"), "rep", "n", "alone", (F.col("alone") + F.col("i")).alias("place"), *[f"m{i}" for i in range(MARK_WORDS)])


def _may_be_similar(percent: int) -> Column:
    """Of rows with columns a_... and b_... of early_places, those that enough shared shingles can follow,
    and whose marks don't differ in more bits than similar sets do in shingles."""
    needed = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent))
    in_time = (F.col("a_place") <= F.col("a_n") - needed) & (F.col("b_place") <= F.col("b_n") - needed)
    differ = F.bit_count(F.col("a_m0").bitwiseXOR(F.col("b_m0")))
    for i in range(1, MARK_WORDS):
        differ = differ + F.bit_count(F.col(f"a_m{i}").bitwiseXOR(F.col(f"b_m{i}")))
    return in_time & _sizes_fit(F.col("a_n"), F.col("b_n"), percent) & (differ <= F.col("a_n") + F.col("b_n") - 2 * needed)


def _side(placed: DataFrame, c: str) -> DataFrame:
    return placed.select("value", *[F.col(x).alias(f"{c}_{x}") for x in placed.columns if x != "value"])


def pivot_meetings(placed: DataFrame, percent: int, folder: str) -> DataFrame:
    """Candidates (a, b): members of mixed lists with the list's pivot, the one with the fewest shingles of its own."""
    every = F.struct(*[c for c in placed.columns if c != "value"])
    pivots = placed.groupBy("value").agg(F.min_by(every, F.struct("alone", "rep")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    pivots = common.kept(_side(pivots.select("value", "p.*"), "b"), f"{folder}/early-pivots")
    met = _side(placed, "a").join(pivots, "value").where((F.col("a_component") != F.col("b_component")) & _may_be_similar(percent))
    return met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def early_meetings(placed: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components that share an early shingle; none that is similar is missed."""
    met = _side(placed, "a").join(_side(placed, "b"), "value").where((F.col("a_component") > F.col("b_component")) & _may_be_similar(percent))
    return met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for all nodes of links.

    Alternates large-star and small-star until the links don't change. Each step is an aggregate and a
    join on the node. For large-star the aggregate is written first, so that Spark can split the join's part
    for the centre of a large star.
    """
    edges = common.kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{folder}/links-0")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, step = mark(edges), 0
    while before[0]:
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{folder}/least-{step}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = common.kept(large, f"{folder}/large-{step}")
        # A node has few smaller ones by now: the centre of a star is on the other side.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = common.kept(small, f"{folder}/small-{step}")
        common.dropped(edges.sparkSession, *(f"{folder}/{x}-{step}" for x in ("least", "large")), f"{folder}/links-0" if step == 1 else f"{folder}/small-{step - 1}")
        after = mark(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(joined: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(node, component) after further links (a, b): only components that these join are looked at."""
    of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    found = common.kept(components(between, folder), f"{folder}/found")
    moved = joined.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.union(found.join(joined, "node", "left_anti").select("node", "component"))


def _named_apart(classes: DataFrame, largest: int, folder: str) -> DataFrame:
    """Names of classes where keys have several sets: set_id, key (the smallest), rep (a number of its own, above all keys if that key stands for another class)."""
    shown = classes.select("set_id", F.col("rep").alias("key"))
    first = common.kept(shown.groupBy("key").agg(F.min("set_id").alias("first")), f"{folder}/first-sets")
    numbered = common.kept(shown.join(first, "key").select("set_id", "key", (F.col("set_id") == F.col("first")).alias("own"), F.monotonically_increasing_id().alias("i")), f"{folder}/class-numbers")
    return common.kept(numbered.select("set_id", "key", F.when(F.col("own"), F.col("key")).otherwise(F.lit(largest) + 1 + F.col("i")).alias("rep")), f"{folder}/class-names")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", retained: int | None = K) -> DataFrame:
    """Rows (key, n_shingles, component_id) for every row: the smallest key reachable over links.

    Sets are linked if 100 * intersection >= percent * union. Null and empty texts, and those without
    words, have an empty set and are linked with nothing; nor are rows without a key, whose component
    is null. Rows with equal sets are linked; rows that share a key are one document, which is
    linked with whatever any of them is linked with. Keys are integers below 2 ** 62, or texts of integers. Long
    texts are hashed in blocks; a text's set is held whole, 8 bytes for each distinct shingle. Other
    columns aren't read. ``retained=None`` retains whole sets: exact, at the cost of listing them all.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the candidate search is made for similarities from 0.8 on")
    if retained is not None and retained < K:
        raise ValueError(f"at least {K} values have to be retained")
    spark = common.ready(docs.sparkSession)
    folder = common.shared_folder(spark, "near-dups")
    rows = common.kept(sketches(docs, size, key, text, retained), f"{folder}/sketches")
    usable = rows.where("set_id is not null and key is not null")
    classes = common.kept(usable.groupBy("set_id").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), f"{folder}/classes")
    # Keys that rows with several sets share; usually there are none.
    told = rows.where("key is not null").groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.count("set_id").alias("sets"), F.count("*").alias("rows"))
    shared = common.kept(told.where("low < high or (sets > 0 and sets < rows)").select("key", "low"), f"{folder}/shared")
    repeated = not shared.isEmpty()
    names = _named_apart(classes, usable.agg(F.max("key")).first()[0], folder) if repeated else None
    classes = classes if names is None else common.kept(classes.drop("rep").join(names.select("set_id", "rep"), "set_id"), f"{folder}/classes-apart")
    lists = common.kept(postings(classes, percent, folder, retained), f"{folder}/lists")

    wanted = lists.select("rep").distinct()
    first = wanted.select(F.col("rep").alias("key")) if names is None else names.join(wanted, "rep", "left_semi").select("key").distinct()
    listed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(first, "key", "left_semi")
    sets = full_sets(listed, size, "key", "text")
    if names is not None:
        sets = sets.join(names, ["key", "set_id"]).dropDuplicates(["rep"]).select(F.col("rep").alias("key"), "shingles", "marks")
    sets = common.kept(sets.select("key", "shingles", "marks"), f"{folder}/sets")

    # Every class of a list meets the list's pivot.
    central = F.struct("central", -F.col("rep"))
    pivots = lists.groupBy("value").agg(F.max_by(F.struct("rep", "n"), central).alias("p"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    pivots = common.kept(pivots.select("value", F.col("p.rep").alias("b"), F.col("p.n").alias("b_n")), f"{folder}/pivots")
    met = lists.join(pivots, "value").where((F.col("rep") != F.col("b")) & _sizes_fit(F.col("n"), F.col("b_n"), percent)).select(F.col("rep").alias("a"), "b").distinct()
    likely = _with_sketches(met, classes).where(union_sketch_estimate(F.col("a_sketch"), F.col("b_sketch"), retained) >= percent / 100 * ESTIMATE_SLACK).select("a", "b")
    similar = 100 * F.col("shared") >= percent * F.col("all")
    links = _exact(likely, sets).where(similar).select("a", "b")
    if repeated:
        # All classes that a key is in are connected through it.
        through = usable.join(shared.select("key"), "key", "left_semi").select("key", "set_id").distinct().join(classes.select("set_id", "rep"), "set_id")
        links = links.union(through.select(F.col("rep").alias("a"), F.col("key").alias("b")))
    links = common.kept(links, f"{folder}/links")
    joined = common.kept(components(links, f"{folder}/components"), f"{folder}/joined")

    # What is left: lists whose members aren't all connected.
    labelled = lists.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = common.kept(labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("value"), f"{folder}/mixed")
    members = common.kept(labelled.join(mixed, "value", "left_semi").select("rep").distinct(), f"{folder}/members")
    placed = common.kept(early_places(members, sets, percent, folder), f"{folder}/placed")
    for way in ("pivot", "early"):
        now = placed.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        met = pivot_meetings(now, percent, folder) if way == "pivot" else early_meetings(now, percent)
        more = common.kept(_exact(met, sets).where(similar).select("a", "b"), f"{folder}/more-{way}")
        if not more.isEmpty():
            joined = common.kept(merged_components(joined, more, f"{folder}/components-{way}"), f"{folder}/joined-{way}")

    common.dropped(spark, *(f"{folder}/{x}" for x in ("counts", "lists", "sets", "pivots", "mixed", "times", "placed", "early-pivots")))

    if repeated:
        # A row without words belongs to the document that its key names.
        rows = rows.join(shared, "key", "left").select("key", "n_shingles", F.coalesce("set_id", "low").alias("set_id"))
    of_class = classes.select("set_id", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of_class, "set_id", "left").select("key", "n_shingles", F.when(F.col("key").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "key")).alias("component_id"))


def digest_rows(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, size=4, percent=80)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, with its own columns; rows without id stay."""
    gone = near_duplicates(docs, size, percent).where("key != component_id").select(F.col("key").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
