"""Array rows of predictions renumbered to their best partners in the gold document.

Level by level, outermost arrays first: rows of one array on both sides are paired so that most
values agree (then most addresses meet), and the index in the prediction's addresses becomes the
partner's, or a label if there is none. An array that only one side has stays as it is.

By what the arrays hold: of scalars, equal values are matched by occurrence number, a plain join. Rows,
with or without arrays inside, are priced by joins and aggregates from the innermost arrays outwards
(``pricing``), and the solver gets the edges of one array, or in large arrays those of one connected component
(``large``). How many pairs a large array would make is known from counts before any is made; one with too
many is crowded, and paired from its rare values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyleaf.functions import addresses as A
from tallyleaf.sources import tables

from . import flatten, large, pricing, small
from .pricing import is_ordered

DOC = "doc_id"
#: Rows of an array on both sides, multiplied, above which it is large; pairs above which a large one is crowded.
LARGE, CROWDED = 1_000_000, 20_000_000


def deepest(*leaves: DataFrame) -> int:
    """Largest number of array levels of any leaf."""
    return max([r or 0 for df in leaves for r in df.agg(F.max(A.index_count(F.col("address")))).first()], default=0)


def at_level(leaves: DataFrame, level: int) -> DataFrame:
    """Leaves inside arrays of that level: doc_id, array, element, rel, and canon if they have it."""
    placed = leaves.withColumn("_at", A.index_place(F.col("address"), level)).where("_at is not null")
    return placed.select(DOC, F.slice("address", F.lit(1), F.col("_at") - 1).alias("array"), F.get("address", F.col("_at") - 1).alias("element"), F.slice("address", F.col("_at") + 1, F.size("address")).alias("rel"), *[c for c in ("canon",) if c in leaves.columns])


def laid(leaves: DataFrame, level: int, path: str) -> DataFrame:
    """at_level, written: what joins infer of arrays and elements is looked up then, where it would be derived from addresses anew each time."""
    return tables.kept(at_level(leaves, level), path)


def _inner_arrays(array: Column, rel: Column, ordered) -> Column:
    """Whether a leaf of a row lies in a further array that is to be paired."""
    prefixes = A.array_prefixes(rel)
    whole = lambda p: A.node_key(F.concat(array, F.array(F.lit(A.INDEX)), p))
    # Under an ordered array everything is compared by place.
    first_ordered = F.exists(F.slice(prefixes, 1, 1), lambda p: is_ordered(whole(p), ordered))
    return (F.size(prefixes) > 0) & ~first_ordered


def _kinds(gold: DataFrame, pred: DataFrame, ordered) -> DataFrame:
    """Arrays of both sides that are to be paired: doc_id, array, kind (scalar, flat or nested), is_large."""

    # Elements are no more than leaves and than the largest index says: numbers that take no room, unlike a sketch per array.
    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.withColumn("_inner", _inner_arrays(F.col("array"), F.col("rel"), ordered))
        return own.groupBy(DOC, "array").agg(F.max(F.size("rel") > 0).alias(f"{name}_rows"), F.max("_inner").alias(f"{name}_inner"), F.least(F.count("*"), F.max(F.substring("element", 2, 1 << 30).cast("long")) + 1).alias(f"{name}_elements"))

    both = side(gold, "g").join(side(pred, "p"), [DOC, "array"]).where(~is_ordered(A.node_key(F.col("array")), ordered))
    kind = F.when(F.col("g_inner") | F.col("p_inner"), "nested").when(F.col("g_rows") | F.col("p_rows"), "flat").otherwise("scalar")
    return both.select(DOC, "array", kind.alias("kind"), (F.col("g_elements") * F.col("p_elements") > LARGE).alias("is_large"))


def scalar_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Equal values by their number of occurrence: as many pairs as both sides have of a value."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        order = W.partitionBy(DOC, "array", "canon").orderBy("element")
        return df.select(DOC, "array", "canon", F.row_number().over(order).alias("nth"), F.col("element").alias(name))

    return numbered(pred, "pred").join(numbered(gold, "gold"), [DOC, "array", "canon", "nth"]).select(DOC, "array", "pred", "gold")


def weights(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of flat rows with an equal value: doc_id, array, pred, gold, matched, shared and content hashes."""
    found, _ = pricing.edges(gold, pred, True, "", False, True)
    return found.select(DOC, "array", "pred", "gold", "matched", "shared", "pred_content", "gold_content")


def pair_bounds(gold: DataFrame, pred: DataFrame, flat: bool = True) -> DataFrame:
    """For arrays of both sides the most pairs that can match anything: doc_id, array, pairs.

    As many as equal values make, but of flat rows no more than there are cells: known from counts alone, without a pair.
    """
    items = lambda df, name: df.groupBy(DOC, "array", F.xxhash64(F.size("rel"), "rel", "canon").alias("value")).agg(F.count("*").alias(name))
    sizes = lambda df, name: df.select(DOC, "array", "element").distinct().groupBy(DOC, "array").agg(F.count("*").alias(name))
    met = items(gold, "g").join(items(pred, "p"), [DOC, "array", "value"]).groupBy(DOC, "array").agg(F.sum(F.col("g") * F.col("p")).alias("met"))
    both = sizes(gold, "gold_rows").join(sizes(pred, "pred_rows"), [DOC, "array"]).join(met, [DOC, "array"], "left")
    met_at_most = F.coalesce("met", F.lit(0))
    return both.select(DOC, "array", (F.least(met_at_most, F.col("gold_rows") * F.col("pred_rows")) if flat else met_at_most).alias("pairs"))


def sorted_out(docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(documents that are paired where they are, the others, values of all at most) of docs with gold and pred; None for no document."""
    own = small.is_small(LARGE)
    found = docs.agg(F.count_if(own).alias("few"), F.count_if(~own).alias("others"), F.sum(small.values_at_most(F.col("gold")) + small.values_at_most(F.col("pred"))).alias("values")).first()
    if not found.others:
        return docs, None, found["values"] or 0
    return (docs.where(own) if found.few else None), (docs.where(~own) if found.few else docs), found["values"]


def document_weights(docs: DataFrame) -> DataFrame:
    """Pairs of rows with an equal value in flat arrays of docs (doc_id, gold, pred, schema): doc_id, array, pred, gold, matched, shared."""
    few, others, _ = sorted_out(docs)
    if others is None:
        return small.weights(few)
    folder = tables.work_folder(docs.sparkSession, "lines")
    gold, pred = (laid(flatten.leaves(others, side, "schema", side, columns=("canon",)), 1, f"{folder}/{side}") for side in ("gold", "pred"))
    found = weights(gold, pred).drop("pred_content", "gold_content")
    return found if few is None else small.weights(few).union(found)


def _large_pairs(gold: DataFrame, pred: DataFrame, scale: DataFrame, ordered, nested: bool, folder: str) -> DataFrame:
    """Pairs of large arrays: crowded ones apart, as the numbers of pairs that they would make say."""
    plain = lambda df: df.withColumn("rel", A.node_key(F.col("rel")))
    found = pair_bounds(plain(gold), plain(pred), not nested).where(F.col("pairs") > CROWDED).select(DOC, "array")
    found = tables.kept(found, f"{folder}/crowded")
    if found.isEmpty():
        edges, blocks = pricing.edges(gold, pred, ordered, folder, nested)
        return _with_blocks(large.matched(edges, folder), blocks)
    of = lambda df, how: df.join(found, [DOC, "array"], how)
    edges, blocks = pricing.edges(of(gold, "left_anti"), of(pred, "left_anti"), ordered, folder, nested)
    paired = large.crowded(of(plain(gold), "left_semi"), of(plain(pred), "left_semi"), scale, CROWDED, f"{folder}/few")
    return _with_blocks(large.matched(edges, folder).union(paired), blocks)


def _with_blocks(pairs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """Pairs and, as rows without a pair, the sizes of blocks inside that weren't solved exactly."""
    none = F.lit(None).cast("string")
    for b in blocks:
        pairs = pairs.union(b.select(DOC, F.lit(None).cast("array<string>").alias("array"), none.alias("pred"), none.alias("gold"), "large"))
    return pairs


def _small_pairs(gold: DataFrame, pred: DataFrame, scale: DataFrame, ordered, nested: bool, folder: str) -> DataFrame:
    edges, blocks = pricing.edges(gold, pred, ordered, folder, nested, not nested)
    return _with_blocks(pricing.groups_matched(edges, *pricing.PLACE, dealt=not nested), blocks)


def level_pairs(gold: DataFrame, pred: DataFrame, scale: DataFrame, ordered, folder: str) -> tuple[DataFrame | None, DataFrame]:
    """(pairs, arrays of both sides) of one level. Only the ways that some array needs are taken."""
    kinds = tables.kept(_kinds(gold, pred, ordered), f"{folder}/kinds")
    present = {(r.kind, r.is_large and r.kind != "scalar") for r in kinds.select("kind", "is_large").distinct().collect()}
    pairs = None
    for kind, is_large in sorted(present):
        mine = kinds.where((F.col("kind") == kind) & (F.lit(kind == "scalar") | (F.col("is_large") == is_large))).select(DOC, "array")
        g, p = ((df if len(present) == 1 and ordered is False else df.join(mine, [DOC, "array"], "left_semi")) for df in (gold, pred))
        if kind == "scalar":
            found = scalar_pairs(g, p).withColumn("large", F.lit(None).cast("int"))
        else:
            found = (_large_pairs if is_large else _small_pairs)(g, p, scale, ordered, kind == "nested", f"{folder}/{kind}-{'large' if is_large else 'small'}")
        pairs = found if pairs is None else pairs.union(found)
    return pairs, kinds.select(DOC, "array")


def aligned(gold: DataFrame, pred: DataFrame, ordered: bool | Sequence[Sequence[str]] = False, levels: int | None = None, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(prediction leaves with the gold's numbering, large blocks that were paired best-first: doc_id, large).

    ``ordered`` names arrays, by node key, that are compared by place; True all, False none. ``levels`` is
    the depth of arrays, if it is known, and ``rows`` the leaves of both sides: tasks grow with them.
    """
    with tables.sized(gold.sparkSession, rows):
        return _aligned(gold, pred, ordered, levels)


def _aligned(gold: DataFrame, pred: DataFrame, ordered: bool | Sequence[Sequence[str]], levels: int | None) -> tuple[DataFrame, DataFrame]:
    spark = tables.ready(gold.sparkSession)
    levels = deepest(gold, pred) if levels is None else levels
    blocks = spark.createDataFrame([], f"{DOC} {gold.schema[DOC].dataType.simpleString()}, large int")
    if levels == 0 or ordered is True:
        return pred, blocks
    folder = tables.work_folder(spark, "align")
    scale = pred.groupBy(DOC).agg((F.count("*") + 1).alias("scale"))
    for level in range(1, levels + 1):
        sides = [laid(df, level, f"{folder}/level-{level}/{name}") for df, name in ((gold, "gold"), (pred, "pred"))]
        pairs, both = level_pairs(*sides, scale, ordered, f"{folder}/level-{level}")
        if pairs is None:
            continue
        with pricing.co_located(spark):
            pairs = tables.kept(pairs, f"{folder}/level-{level}/pairs")
        blocks = blocks.union(pairs.where("large is not null").select(DOC, "large"))
        place = A.index_place(F.col("address"), level)
        placed = pred.withColumn("_at", place).withColumns({"array": F.when(F.col("_at").isNotNull(), F.slice("address", F.lit(1), F.col("_at") - 1)), "element": F.get("address", F.col("_at") - 1)})
        partner = pairs.where("large is null").select(DOC, "array", F.col("pred").alias("element"), F.col("gold").alias("_to"))
        met = placed.join(both.withColumn("_both", F.lit(True)), [DOC, "array"], "left").join(partner, [DOC, "array", "element"], "left")
        label = F.concat(F.lit(A.LABEL + "p"), F.substring("element", 2, 1 << 30).try_cast("bigint").cast("string"))
        step = F.when(F.col("element").startswith(A.LABEL), F.col("element")).otherwise(F.coalesce("_to", label))
        renumbered = F.when(F.col("_both"), F.concat(F.col("array"), F.array(step), F.slice("address", F.col("_at") + 1, F.size("address")))).otherwise(F.col("address"))
        pred = tables.kept(met.withColumn("address", renumbered).select(*pred.columns), f"{folder}/moved-{level}")
    return pred, blocks
