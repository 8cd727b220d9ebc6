"""Merkle manifests: a tree over the documents of each language, and one over the trees' roots.

Leaves are numbered in order by a range partitioning and counts per partition. Aligned blocks of them,
FANOUT ** DEPTH in a row, are complete subtrees: a task traverses each in postorder and returns its
root. The roots of a language's blocks are the leaves of the next traversal, until each language has one
root. On the way back the traversal of a block appends to every leaf the siblings that it meets while
unwinding, in front of those of the block's own root. A task holds one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Nodes in a run; levels of a block's subtree.
FANOUT, DEPTH = 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_hash(digests: list[bytes]) -> bytes:
    """Hash of digests in a row, as hex text; raw."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf(*values: Column) -> Column:
    """Raw hash of a row: ``-`` for null, else the number of bytes, a colon and the value."""
    said = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]), 256))


def traversed(nodes: list[bytes], height: int, above: bytes | None) -> tuple[bytes, list[bytes]]:
    """Root of the tree of that height over nodes, and the proof of each node; without ``above`` no proofs are made.

    A proof has a part for each level, from the node to the root: the node's place in its run, the number
    of its siblings, and these, raw. ``above`` goes after the parts of this tree.
    """
    proofs: list[list[bytes]] = [[] for _ in nodes] if above is not None else []

    def visit(low: int, high: int, level: int) -> bytes:
        if level == 0:
            return nodes[low]
        width = FANOUT ** (level - 1)
        starts = range(low, high, width)
        below = [visit(at, min(at + width, high), level - 1) for at in starts]
        if above is not None:
            for i, at in enumerate(starts):
                part = bytes([i, len(below) - 1]) + b"".join(below[:i] + below[i + 1 :])
                for proof in proofs[at : min(at + width, high)]:
                    proof.append(part)
        return joined_hash(below)

    root = visit(0, len(nodes), height)
    return root, [b"".join([*p, above]) for p in proofs] if above is not None else []


def proof_parts(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) by level, from the leaf up."""
    at = 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1]
        yield place, [proof[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def folded(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for place, siblings in proof_parts(proof):
        digest = joined_hash([*siblings[:place], digest, *siblings[place:]])
    return digest


def proof_hash(proof: bytes) -> bytes:
    return joined_hash([s for _, siblings in proof_parts(proof) for s in siblings])


def numbered(nodes: DataFrame, order: list[Column], folder: str) -> DataFrame:
    """Nodes (grp, ...) with ``pos``, from 0 in each group by that order, and ``total``, the group's size.

    Group and order have to tell rows apart as far as equal ones may be more than a partition can hold.
    """
    n = common.partitions(nodes.sparkSession)
    placed = nodes.repartitionByRange(n, F.col("grp").asc_nulls_first(), *order).sortWithinPartitions(F.col("grp").asc_nulls_first(), *order)
    rows = common.kept(placed.withColumn("ord", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), folder + "/ordered")
    counts = common.kept(rows.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("ord").alias("low")), folder + "/counts")
    # As many rows of a group as it has partitions.
    before = F.expr("sum(n) over (partition by grp order by part) - n - low")
    shifts = counts.select("grp", "part", before.alias("shift"), F.expr("sum(n) over (partition by grp)").alias("total"))
    met = rows.alias("r").join(common.kept(shifts, folder + "/shifts").alias("s"), F.col("r.grp").eqNullSafe(F.col("s.grp")) & (F.col("r.part") == F.col("s.part")))
    return met.select("r.*", (F.col("ord") + F.col("shift")).alias("pos"), "total").drop("ord", "part")


def _height(total: int, depth: int) -> int:
    """Levels of a block: as many as its tree has if it is the only one of its group."""
    height = 0
    while height < depth and FANOUT**height < total:
        height += 1
    return height


def _by_block(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes (grp, pos, total, ...) with their block, each block in one partition and in order."""
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth).cast("long")).repartition(common.partitions(nodes.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks from sorted batches, one after the other."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, blocks = batch["grp"].to_pylist(), batch["block"].to_pylist()
        cuts = [i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1] or groups[i] != groups[i - 1]]
        if waiting and (waiting[-1]["block"][-1].as_py(), waiting[-1]["grp"][-1].as_py()) != (blocks[0], groups[0]):
            yield pa.Table.from_batches(waiting)
            waiting = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            yield pa.Table.from_batches([*waiting, batch.slice(low, high - low)])
            waiting = []
        waiting.append(batch.slice(cuts[-1] if cuts else 0))
    if waiting:
        yield pa.Table.from_batches(waiting)


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """Roots of the blocks of nodes (grp, pos, total, digest): the nodes of the next traversal, with the same columns."""
    kind, size = nodes.schema["grp"].dataType.simpleString(), FANOUT**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            total = t["total"][0].as_py()
            root, _ = traversed(t["digest"].to_pylist(), _height(total, depth), None)
            yield pa.RecordBatch.from_arrays([t["grp"].slice(0, 1).combine_chunks(), pa.array([t["block"][0].as_py()]), pa.array([-(-total // size)]), pa.array([root], pa.binary())], names=["grp", "pos", "total", "digest"])

    wanted = _by_block(nodes.select("grp", "pos", "total", "digest"), depth)
    return wanted.mapInArrow(run, f"grp {kind}, pos long, total long, digest binary")


def block_proofs(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Nodes with ``proof``, as above has it for the roots of their blocks (grp, pos), and the other columns of above."""
    placed = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth).cast("long"))
    more = [c for c in above.columns if c not in ("grp", "pos", "proof")]
    up = above.select(F.col("grp").alias("up_grp"), F.col("pos").alias("up_pos"), F.col("proof").alias("up"), *more)
    met = placed.join(up, F.col("grp").eqNullSafe(F.col("up_grp")) & (F.col("block") == F.col("up_pos"))).drop("block", "up_grp", "up_pos")
    sorted_ = _by_block(met, depth)
    names = [c for c in sorted_.columns if c not in ("up", "block")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_.select(*names).schema) + ", proof binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            _, proofs = traversed(t["digest"].to_pylist(), _height(t["total"][0].as_py(), depth), t["up"][0].as_py())
            out = t.select(names).append_column("proof", pa.array(proofs, pa.binary()))
            yield from out.combine_chunks().to_batches()

    return sorted_.mapInArrow(run, fields)


def forest(nodes: DataFrame, folder: str, depth: int = DEPTH) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(roots (grp, digest), attach) of numbered nodes (grp, pos, total, digest, ...).

    ``attach(tops)`` takes the groups' roots with their own proofs (grp, proof, ...) and gives all
    nodes with theirs. Each traversal divides the number of nodes by FANOUT ** depth.
    """
    levels = [nodes]
    while True:
        at = len(levels)
        roots = common.kept(block_roots(levels[-1], depth), f"{folder}/roots-{at}")
        levels.append(roots)
        if (roots.agg(F.max("total").alias("most")).first().most or 1) == 1:
            break

    def attached(tops: DataFrame) -> DataFrame:
        found = tops.withColumn("pos", F.lit(0).cast("long"))
        for i in range(len(levels) - 2, -1, -1):
            found = block_proofs(levels[i], found, depth)
            if i:
                more = [c for c in tops.columns if c not in ("grp", "proof")]
                found = common.kept(found.select("grp", "pos", "proof", *more), f"{folder}/proofs-{i}")
        return found

    return levels[-1].select("grp", "digest"), attached


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", depth: int = DEPTH, tampered: Column | None = None) -> DataFrame:
    """Rows (key, grp, leaf, proof, subroot, root, and tampered_leaf) of all documents, hashes raw.

    Leaves of a group ascend by key, those without a key first, and of one key by their hash; equal rows are
    leaves each. Documents without a group are one group, the first. Texts of any length are hashed
    whole, in the JVM. ``tampered`` is a condition: where it holds, tampered_leaf is the leaf of the row with
    A-Z of the text in lower case, else the leaf. An empty table gives no rows; other columns aren't read.
    """
    spark = common.ready(docs.sparkSession)
    folder = common.shared_folder(spark, "merkle")
    as_is = [F.col(f"`{c}`") for c in columns]
    lowered = [F.translate(F.col(f"`{c}`"), UPPER, LOWER) if c == text else F.col(f"`{c}`") for c in columns]
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{group}`").cast("string").alias("grp"), leaf(*as_is).alias("digest"), F.when(changed, leaf(*lowered)).alias("other"))
    # Rows are numbered before they are dealt: equal ones can be parted.
    rows = common.kept(rows.withColumn("row", F.monotonically_increasing_id()), f"{folder}/leaves")
    leaves = common.kept(numbered(rows, [F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")], f"{folder}/order").drop("row"), f"{folder}/numbered")
    subroots, attach = forest(leaves, f"{folder}/leaves-up", depth)
    subroots = common.kept(subroots, f"{folder}/subroots")
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = common.kept(numbered(named, [F.col("name").asc_nulls_first()], f"{folder}/groups"), f"{folder}/tops")
    roots, attach_tops = forest(tops, f"{folder}/groups-up", depth)
    # One root, if there is any.
    top = roots.select("grp", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
    proven = common.kept(attach_tops(top).select(F.col("name").alias("grp"), "proof", F.col("digest").alias("subroot"), "root"), f"{folder}/group-proofs")
    return attach(proven).select("key", "grp", F.col("digest").alias("leaf"), "proof", "subroot", "root", F.coalesce("other", "digest").alias("tampered_leaf"))


def third(key: Column) -> Column:
    """Whether 3 divides the unsigned crc32 of a key's decimal text; null: no."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 0, F.lit(False))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof_nodes of every row; cases as in manifest()."""

    @F.arrow_udf("proof_sha256 string, folded_root string, proof_nodes int")
    def checked(proofs: pa.Array, leaves: pa.Array) -> pa.Array:
        pairs = list(zip(proofs.to_pylist(), leaves.to_pylist(), strict=True))
        return pa.StructArray.from_arrays([pa.array([proof_hash(p).hex() for p, _ in pairs], pa.string()), pa.array([folded(x, p).hex() for p, x in pairs], pa.string()), pa.array([sum(len(s) for _, s in proof_parts(p)) for p, _ in pairs], pa.int32())], names=["proof_sha256", "folded_root", "proof_nodes"])

    found = manifest(docs, tampered=third(F.col("doc_id")))
    shown = found.select(F.col("key").alias("doc_id"), *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], checked("proof", "tampered_leaf").alias("c"))
    return shown.select("doc_id", "leaf", "subroot", "root", "c.proof_sha256", "c.folded_root", (F.col("c.folded_root") == F.col("root")).alias("verified"), "c.proof_nodes")
