"""Quality rules by cross-document line frequency. DataFrame functions only.

Lines are normalised and hashed; for every host the distinct documents that have a line are counted.
Lines above the limit are removed, and documents that lose most of their words to that are rejected,
as are those that fail base rules. Where near-duplicates are removed later, a second limit on the
different texts that have a line can keep apart what is boilerplate and what is one page's copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A line is removed if more distinct documents of one host have it, and, with a limit on texts, if these are of more
#: different texts (copies that differ in case and blanks are one text). A document is rejected if it loses a larger share of its
#: words. Both limits are numbers at any size of a host: what 21 documents say alike is boilerplate in a large host too.
LINE_LIMIT, TEXT_LIMIT, LOST_SHARE = 20, 0, 0.8
#: Base rules: least number of words, largest share of words in repeated windows, words in a window.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 0.3, 8
#: What parts words, and symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"


def words(text: Column) -> Column:
    """Words of a text, in order."""
    trimmed = F.regexp_replace(text, rf"\A{SPACE}+", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(common.let(F.split(trimmed, f"{SPACE}+"), lambda w: F.when(F.element_at(w, -1) == "", F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w)))


def repeated_words(hashes: Column) -> Column:
    """Number of words in windows that come more than once; hashes: of the windows, by place.

    Windows are sorted by hash, so equal ones are neighbours; of the places of those that have an
    equal neighbour, each covers a window's length or what is left up to the next one.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    def places(s: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["p"]))

    in_order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = common.let(in_order, lambda s: common.let(places(s), covered))
    return common.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.lit(0).cast("long")))


def window_hashes(w: Column) -> Column:
    """Hashes of the windows of words; none if there are fewer words."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return common.let(hashed, lambda h: F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")))


def base_measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; from column ``text``, nulls empty."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumns({
        "_w": words(F.col("text")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        "word_chars": (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long"),
        "n_dup_lines": common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    both = common.let(F.col("_w"), lambda w: F.struct(F.size(w).cast("long").alias("n"), common.let(window_hashes(w), repeated_words).alias("r")))
    measured = counted.withColumn("_m", both).withColumns({"n_words": F.col("_m.n"), "n_repeat_words": F.col("_m.r")}).drop("_w", "_m")
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")))


def _line_word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _normal(line: Column) -> Column:
    """Lower case, blanks as one."""
    return F.trim(F.regexp_replace(F.lower(line), f"{SPACE}+", " "))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def document_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures of every row, with what its lines need: k1, k2 (which tell rows apart: equal rows have
    the same), id, measures, base_failed, host, doc (its id's hash; without an id the row's), text_hash, lines (array of line, words, place), no texts."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(host).cast("string").alias("_host"))
    placed = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("place"))), lambda y: _has_word(y["x"]))
    hashed = F.transform(placed, lambda y: F.struct(F.xxhash64(_normal(y["x"])).alias("line"), _line_word_count(y["x"]).alias("words"), y["place"].alias("place")))
    k1, k2 = _row_key("id", "_host", "text")
    measured = base_measures(rows.withColumns({"k1": k1, "k2": k2, "lines": hashed}))
    host_hash = F.xxhash64(F.col("_host").isNull(), F.coalesce("_host", F.lit("")))
    return measured.withColumns({"host": host_hash, "text_hash": F.xxhash64("lines.line"), "doc": F.when(F.col("id").isNull(), F.xxhash64("k1", "k2")).otherwise(F.xxhash64("id"))}).drop("text", "_host")


def frequent_lines(rows: DataFrame, limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT) -> DataFrame:
    """Lines (host, line, documents) that more documents than the limit have, and, if there is a limit on texts, more
    different texts; from document_rows. Rows that share an id are one document, and so are repeated rows without one."""
    each = rows.select("host", "doc", "text_hash", F.explode(F.array_distinct("lines.line")).alias("line"))
    frequent = each.select("host", "line", "doc").distinct().groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > limit)
    if not text_limit:
        return frequent
    texts = each.join(frequent, ["host", "line"]).select("host", "line", "documents", "text_hash").distinct().groupBy("host", "line", "documents").agg(F.count("*").alias("texts"))
    return texts.where(F.col("texts") > text_limit).select("host", "line", "documents")


def removed_lines(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """What documents lose: k1, k2, places (of lines in the text), lost (words); only documents that lose any."""
    lines = rows.select("k1", "k2", "host", F.explode("lines").alias("l")).select("k1", "k2", "host", "l.place", "l.line", "l.words")
    hit = lines.join(frequent.select("host", "line"), ["host", "line"])
    once = hit.groupBy("k1", "k2", "place").agg(F.max("words").alias("words"))
    return once.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("place")).alias("places"), F.sum("words").alias("lost"))


def _row_key(key: str, host: str, text: str) -> tuple[Column, Column]:
    """Two hashes that tell rows apart: repeated rows have the same."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    parts = [F.col(key), F.col(host).cast("string"), F.length(whole), F.xxhash64(whole)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts, F.crc32(whole))


def _judged(docs: DataFrame, key: str, text: str, host: str, limit: int, text_limit: int, lost_share: float) -> DataFrame:
    folder = common.shared_folder(docs.sparkSession, "line-rules")
    rows = common.kept(document_rows(docs, key, text, host), f"{folder}/rows")
    frequent = common.kept(frequent_lines(rows, limit, text_limit), f"{folder}/frequent")
    joined = rows.drop("lines", "host", "doc", "text_hash").join(removed_lines(rows, frequent), ["k1", "k2"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= lost_share * F.col("n_words")))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT, lost_share: float = LOST_SHARE) -> DataFrame:
    """Key (its own name), measures, lost, places (of removed lines), base_failed and kept of every document.

    Null texts are empty. Rows with equal keys are one document where lines are counted, and each is judged by its
    own text; repeated rows are judged alike and all returned. Null hosts are one host, another
    than that of an empty name. Very long lines and texts are read whole. An empty table gives no rows.
    Columns other than these three are not read.
    """
    common.ready(docs.sparkSession)
    return _judged(docs, key, text, host, limit, text_limit, lost_share).drop("k1", "k2").withColumnRenamed("id", key)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, base measures, base_failed, kept, lost_words and removed_lines of every row; odd rows fare as in judged()."""
    found = judged(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lost").alias("lost_words"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("removed_lines"))


def without_lines(text: Column, places: Column) -> Column:
    """A text without its lines at those places; a null or empty array removes none."""

    def left(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        gone = F.transform(places, lambda p: F.struct(p.alias("i"), F.get(lines, p).alias("x")))
        return F.array_join(F.transform(F.array_except(numbered, gone), lambda y: y["x"]), "\n")

    return F.when(F.coalesce(F.size(places), F.lit(0)) > 0, common.let(F.split(text, "\n"), left)).otherwise(text)


def keep_good(docs: DataFrame, limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT, lost_share: float = LOST_SHARE) -> DataFrame:
    """Documents that the rules keep, with their own columns, their texts without the removed lines; odd rows fare as in judged().

    An integer column n_chars, where there is one, is set anew for texts that lose lines.
    """
    common.ready(docs.sparkSession)
    names = [common.free_name(docs, x) for x in ("_k1", "_k2", "_kept", "_places")]
    judged_rows = _judged(docs, "doc_id", "text", "source", limit, text_limit, lost_share)
    changed = judged_rows.where(~F.col("kept") | (F.col("lost") > 0)).groupBy("k1", "k2").agg(F.first("kept").alias("kept"), F.first("places").alias("places"))
    changed = changed.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), F.col("kept").alias(names[2]), F.col("places").alias(names[3]))
    rows = docs.withColumns(dict(zip(names[:2], _row_key("doc_id", "source", "text"), strict=True)))
    good = rows.join(changed, names[:2], "left").where(F.coalesce(names[2], F.lit(True)))
    cleaned = good.withColumn("text", without_lines(F.col("text"), F.col(names[3])))
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        cleaned = cleaned.withColumn("n_chars", F.when(F.size(names[3]) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])
