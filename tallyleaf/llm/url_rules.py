"""URL filtering: fixed host and path rules, and association rules mined with Spark's FP-growth.

URL tokens of labelled pages are the transactions. Combinations of tokens that have enough support and
confidence for "block" are rules. An inverted index holds every rule at its rarest part; a URL meets the rules of
its tokens there and is blocked by those whose other parts it has too. DataFrame functions only.

Tokens that the same pages have are one class, mined as one and written as one part of a rule; a class
that is a rule by itself is in no other rule. FP-growth's work doubles with every token of a page, so wide pages
are taken apart as it does itself: for each class the pages that have it, with the classes that come
later in the order, are a database of their own, in which classes are made anew. Most tokens of a wide page
are the same there. This goes on until no page of a database is wide, or rules of MAX_RULE parts are
counted. The narrow ones are mined by FP-growth, all at once: their classes have names of their own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Verdict, host (with its subdomains), beginning of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BAD, GOOD = "label=bad", "label=good"
#: Least share and number of labelled pages that a rule's tokens and label have together; least share of bad ones among pages with its tokens.
MIN_SHARE, MIN_PAGES, MIN_CONFIDENCE = 0.002, 5, 0.8
#: Most parts of a rule: longer combinations aren't mined. Classes of a page up to which FP-growth mines its database whole.
MAX_RULE, WIDE = 5, 8
#: Rows of a table of classes up to which it is broadcast.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (size, verdict, rule) of the longest rule that fits, or null. Of equally long ones block wins."""
    fits = [
        F.when((host_ == h) | host_.endswith("." + h), F.when(path_.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def tokens(url: Column) -> Column:
    """Distinct tokens: the host and its parents, host labels, path parts and query keys; digits are 0."""
    h = host(url)
    parents = common.let(F.split(h, r"\."), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(x, i, F.size(x)), "."))))
    labels = F.transform(F.split(h, r"[.\-]"), lambda x: F.concat(F.lit("label:"), x))
    parts = F.transform(F.split(F.lower(path(url)), r"[/.]"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.filter(F.concat(parents, labels, parts, keys), lambda x: ~x.endswith("=") & ~x.endswith(":")))


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token lists (items) of labelled pages, with the label; URLs of any length whole, null ones left out.

    A page labelled twice is bad if any label says so, repeated pages are repeated lists, and empty
    tables give none. Other columns aren't read.
    """
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    found = pages.where("url is not null").select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id"))
    return found.select(F.array_append(tokens(F.col("url")), F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))).alias("items"))


class Rules(NamedTuple):
    """Rules (parts, key, confidence, pages), where pages are the bad ones that the rule met, and what their parts stand for: (part, token)."""

    rules: DataFrame
    members: DataFrame


def _stats(rows: DataFrame) -> DataFrame:
    """prefix, token, pages, bad (pages with it), and two hashes of the set of transactions that have it; rows: prefix, t, n, bad, tokens."""
    each = rows.select("prefix", "t", "n", "bad", F.explode("tokens").alias("token"))
    return each.groupBy("prefix", "token").agg(F.sum("n").alias("pages"), F.sum("bad").alias("bad"), F.bit_xor(F.xxhash64("t")).alias("h1"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("h2"))


def _classes(stats: DataFrame) -> DataFrame:
    """Classes (prefix, part, pages, bad, members) of tokens that the same pages of a database have. A page's tokens bound its classes."""
    found = stats.groupBy("prefix", "pages", "bad", "h1", "h2").agg(F.min("token").alias("least"), F.collect_list("token").alias("members"))
    return found.select("prefix", F.md5(F.array_join(F.array_append("prefix", F.col("least")), "\x1f")).alias("part"), "pages", "bad", "members")


def _transactions_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with classes in place of tokens, in one order for each database: from the rarest. Rows with fewer than two go."""
    names = classes.select("prefix", "part", "pages", F.explode("members").alias("token"))
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    each = rows.select("prefix", "t", "n", "bad", F.explode("tokens").alias("token")).join(names, ["prefix", "token"])
    grouped = each.groupBy("prefix", "t").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.array_sort(F.collect_set(F.struct("pages", "part"))).alias("x"))
    return grouped.where(F.size("x") > 1).select("prefix", "t", "n", "bad", F.transform("x", lambda x: x["part"]).alias("tokens"))


def _projected(rows: DataFrame) -> DataFrame:
    """For each class of a row a row of that class's database, with the classes after it."""
    each = rows.select("prefix", "t", "n", "bad", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - 1)).alias("i", "part"))
    return each.select(F.array_append("prefix", F.col("part")).alias("prefix"), "t", "n", "bad", F.slice("tokens", F.col("i") + 2, F.size("tokens")).alias("tokens"))


def _subsets(parts: str) -> Column:
    """All proper subsets, other than the empty one, of a sorted array."""
    return F.expr(f"transform(sequence(1, greatest(1, shiftleft(1, size({parts})) - 2)), m -> filter({parts}, (x, i) -> (shiftright(m, i) & 1) = 1))")


def _minimal(rules: DataFrame) -> DataFrame:
    """Rules of which no proper subset is one."""
    inner = rules.where(F.size("parts") > 1).select("parts", F.explode(_subsets("parts")).alias("small"))
    larger = inner.join(rules.select(F.col("parts").alias("small")), "small").select("parts").distinct()
    return rules.join(larger, "parts", "left_anti")


def _recounted(sets: DataFrame, rows: DataFrame, rarest: DataFrame) -> DataFrame:
    """pages and bad of sets of classes, over all rows that have them."""
    keyed = _keyed(sets, rarest)
    met = rows.select("n", "bad", F.col("tokens").alias("has"), F.explode("tokens").alias("key")).join(keyed.hint("merge"), "key")
    return met.where(F.size(F.array_except("parts", "has")) == 0).groupBy("parts").agg(F.sum("n").alias("pages"), F.sum("bad").alias("bad"))


def _keyed(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Sets (parts) with their rarest part as key."""
    each = sets.select("parts", F.explode("parts").alias("part")).join(classes.select("part", F.col("pages").alias("of_part")), "part")
    return each.groupBy("parts").agg(F.min_by("part", F.struct("of_part", "part")).alias("key"))


def _grown(rows: DataFrame, classes: DataFrame, least: float, min_confidence: float, longest: int, folder: str) -> DataFrame | None:
    """Rules (parts, pages, bad) of two and more classes of narrow databases, by FP-growth over their bad pages; without prefixes."""
    bad = rows.where("bad > 0").select(F.col("tokens").alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "bad")).alias("i")).select("items")
    n = bad.count()
    if n < least:
        return None
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), numPartitions=common.partitions(rows.sparkSession)).fit(bad)
    sets = model.freqItemsets.where(F.size("items").between(2, longest)).select(F.array_sort("items").alias("parts"))
    sets = common.kept(sets, f"{folder}/sets")
    counted = _recounted(sets, rows, classes).where((F.col("bad") >= least) & (F.col("bad") >= min_confidence * F.col("pages")))
    return _minimal(common.kept(counted, f"{folder}/grown"))


def mine(lists: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, max_rule: int = MAX_RULE, wide: int = WIDE) -> Rules:
    """Rules for blocking, from transactions (items, with the label); null items are no page.

    All combinations of at most ``max_rule`` classes with that support and confidence, but for those of
    which an earlier part is a rule. No labelled pages: no rules. Repeated pages count each time. The work grows with
    a page's classes to the power of the rule's length at most, and pages of any length are mined whole.
    """
    spark = lists.sparkSession
    folder = common.shared_folder(spark, "url-mining")
    own = F.array_sort(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD)))).alias("tokens")
    once = lists.where("items is not null").select(F.array_contains("items", BAD).cast("long").alias("bad"), own).groupBy("tokens").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    rows = common.kept(once.select(F.array().cast("array<string>").alias("prefix"), F.monotonically_increasing_id().alias("t"), "n", "bad", "tokens"), f"{folder}/rows-0")
    least = max(min_share * (rows.agg(F.sum("n")).first()[0] or 0), min_pages)
    good = F.col("bad") >= min_confidence * F.col("pages")
    rules, every, members, narrow = [], [], [], []
    for depth in range(max_rule):
        classes = common.kept(_classes(_stats(rows).where(F.col("bad") >= least)), f"{folder}/classes-{depth}")
        rules.append(classes.where(good).select(F.array_append("prefix", F.col("part")).alias("parts"), "pages", "bad"))
        every.append(classes.select("part", "prefix", "pages"))
        inside = classes.select("part", F.explode("members").alias("token"))
        if members:
            # Tokens are classes of the database before.
            inside = inside.join(members[-1].select(F.col("part").alias("token"), F.col("token").alias("name")), "token").select("part", F.col("name").alias("token"))
        members.append(common.kept(inside, f"{folder}/members-{depth}"))
        if depth + 1 == max_rule:
            break
        grouped = common.kept(_transactions_of(rows, classes.where(~good)), f"{folder}/grouped-{depth}")
        widths = common.kept(grouped.groupBy("prefix").agg(F.max(F.size("tokens")).alias("width")).where(F.col("width") > wide), f"{folder}/wide-{depth}")
        if widths.isEmpty():
            narrow.append(grouped)
            break
        narrow.append(grouped.join(widths, "prefix", "left_anti"))
        rows = common.kept(_projected(grouped.join(widths.select("prefix"), "prefix", "left_semi")), f"{folder}/rows-{depth + 1}")

    union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].union(tables[1]), *tables[2:]])
    every = common.kept(union(every), f"{folder}/classes")
    found = union(rules)
    grown = _grown(common.kept(union(narrow), f"{folder}/narrow"), every, least, min_confidence, max_rule, folder) if narrow else None
    if grown is not None:
        # A set is of one database: what its classes are in comes before it.
        placed = grown.join(every.select("part", "prefix"), F.get("parts", F.lit(0)) == F.col("part")).where(F.size("prefix") + F.size("parts") <= max_rule)
        found = found.union(placed.select(F.concat("prefix", "parts").alias("parts"), "pages", "bad"))
    found = common.kept(found.select(F.array_sort("parts").alias("parts"), "pages", "bad"), f"{folder}/found")
    keyed = found.join(_keyed(found, every), "parts").select("parts", "key", (F.col("bad") / F.col("pages")).alias("confidence"), F.col("bad").cast("double").alias("pages"))
    used = found.select(F.explode("parts").alias("part")).distinct()
    return Rules(common.kept(keyed, f"{folder}/rules"), common.kept(union(members).join(used, "part"), f"{folder}/members"))


def matches(urls: DataFrame, rules: Rules) -> DataFrame:
    """Distinct URLs that a rule blocks, with the confidence of the best one: a URL has a part if it has any of its tokens."""
    listed = urls.select("url").where("url is not null").distinct()
    met = listed.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(rules.members, "token").groupBy("url").agg(F.collect_set("part").alias("has"))
    keyed = met.select("url", "has", F.explode("has").alias("key")).join(rules.rules.select("parts", "key", "confidence"), "key")
    return keyed.where(F.size(F.array_except("parts", "has")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: Rules, fixed=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row; repeated rows stay.

    The fixed rule's verdict if one fits, else block if a mined rule matches, else allow.
    Null URLs have an empty host and path and are allowed. Other columns are not read.
    """
    rows = pages.select("page_id", "url")
    judged = rows.join(matches(rows, rules), "url", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule = fixed_rule(F.col("host"), F.col("path"), fixed)
    return judged.withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "confidence")


def digest_rows(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, repeated ones too; an empty table gives none, other columns aren't read. Odd URLs as in judge()."""
    return judge(pages, mine(transactions(pages, labels))).select("page_id", "host", "path", "rule", "verdict")
