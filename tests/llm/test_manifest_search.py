"""Merkle manifests, ranked search and exact deduplication against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyleaf.llm import exact_dedup, merkle, ranked_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest int, `row` int, terms string, i int"


def docs(spark, rows, parts=3):
    """rows (doc_id, text, lang, source, n_chars), with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "g", 1, 2, "t", 3) for r in rows], SCHEMA).repartition(parts)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def said(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """Root, and for each node [(siblings before, siblings after)] by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = nodes[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
            paths[k].append((run[: at[k] % 8], run[at[k] % 8 + 1 :]))
        nodes, at = [sha("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)], [x // 8 for x in at]
    return nodes[0], paths


def brute_manifest(rows):
    leaf = lambda r, t: said((r[0], r[3], r[2], r[4], t))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names, out, tops = sorted(groups, key=lambda x: (x is not None, (x or "").encode())), [], []
    for name in names:
        mine = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        root, paths = climbed([leaf(r, r[1]) for r in mine])
        tops.append((root, mine, paths))
    root, above = climbed([t[0] for t in tops]) if tops else ("", [])
    for (sub, mine, paths), up in zip(tops, above, strict=True):
        for r, path in zip(mine, paths, strict=True):
            proof = [*path, *up]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            fold = leaf(r, text)
            for a, b in proof:
                fold = sha("".join([*a, fold, *b]))
            out.append((r[0], leaf(r, r[1]), sub, root, sha("".join("".join(a + b) for a, b in proof)), fold, fold == root, sum(len(a) + len(b) for a, b in proof)))
    return sorted(out, key=str)


def manifest_rows(r, n, langs):
    text = lambda: "".join(r.choice("Ab é\nZ🙂") for _ in range(r.randint(0, 30)))
    return [(i, text(), r.choice(langs), r.choice(["s", "", None]), r.choice([3, -1, None])) for i in r.sample(range(10**6), n)]


@pytest.mark.parametrize(("n", "langs"), [(0, ["en"]), (1, ["en"]), (8, ["en"]), (9, [None]), (66, ["en", None]), (700, ["en"] * 30 + ["fr", "", None]), (60, [f"l{i}é" for i in range(40)] + ["Z", None])])
def test_manifests(spark, n, langs):
    rows = manifest_rows(random.Random(n), n, langs)
    got = [tuple(x) for x in merkle.digest_rows(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_manifest(rows)
    assert n < 60 or {True, False} == {x[6] for x in got}


def test_manifest_of_odd_rows(spark):
    rows = manifest_rows(random.Random(3), 20, ["en", "fr"])
    rows += [(None, "x", "en", None, None)] * 3 + [(5, "A", "fr", "s", 1), (5, "B", "fr", "s", 1), (5, "A", "fr", "s", 1), (6, None, None, None, None), (7, "Long Text " * 200_000, "en", "s", 9)]
    rows += [(1, "same", "de", "s", 0)] * 150  # equal rows, more than a run
    got = [tuple(x) for x in merkle.digest_rows(docs(spark, rows, 5)).collect()]
    assert sorted(got, key=str) == brute_manifest(rows)


@pytest.mark.parametrize("depth", [1, 2])
def test_traversals_feed_each_other(spark, depth):
    """Blocks of one and two levels, so that several traversals are needed; every proof leads to the root."""
    rows = manifest_rows(random.Random(depth), 600, ["en"] * 20 + ["fr"])
    found = merkle.manifest(docs(spark, rows), depth=depth).collect()
    want = {x[0]: x for x in brute_manifest(rows)}
    for x in found:
        assert (bytes(x.leaf).hex(), bytes(x.subroot).hex(), bytes(x.root).hex(), merkle.proof_hash(bytes(x.proof)).hex()) == want[x.key][1:5]
        assert merkle.folded(bytes(x.leaf), bytes(x.proof)) == bytes(x.root)
    assert len(found) == 600


def test_blocks_are_whole_in_any_batches():
    import pyarrow as pa

    rows = [(g, b) for g in (None, "a", "b") for b in range(4) for _ in range(3)]
    table = pa.table({"grp": pa.array([g for g, _ in rows]), "block": pa.array([b for _, b in rows])})
    for size in (1, 2, 3, 5, 7, 100):
        batches = table.to_batches(max_chunksize=size)
        batches.insert(1, batches[0].slice(0, 0))
        got = [(t["grp"].to_pylist(), t["block"].to_pylist()) for t in merkle._blocks(iter(batches))]
        assert got == [([g] * 3, [b] * 3) for g in (None, "a", "b") for b in range(4)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(rows, items, top=50):
    found = [(r[0], Counter(words(r[1]))) for r in rows]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc, c in found:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, n, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "top", "block"), [(1, 50, 8_000), (2, 3, 40)])
def test_search(spark, monkeypatch, seed, top, block):
    r = random.Random(seed)
    vocabulary = ["the", "And", "é", "größe", "x1", "日本", "z"] + [f"w{i}" for i in range(120)]
    prose = lambda n: r.choice([" ", "\x00", "-", "_", "\n"]).join(r.choice(vocabulary[: r.choice([5, 30, 127])]) for _ in range(n))
    rows = [(i, prose(r.randint(0, 80)), "en", "s", 0) for i in r.sample(range(10**6), 700)]
    rows += [(i + 10**7, rows[i][1], "en", "s", 0) for i in range(0, 300, 2)]  # ties
    rows += [(None, rows[1][1], None, None, None)] * 2 + [rows[2]] * 2 + [(3 * 10**7, None, "en", "s", 0), (4 * 10**7, "", "en", "s", 0), (5 * 10**7, "?!", "en", "s", 0), (6 * 10**7, "The W1 " * 200_000, "en", "s", 0)]
    items = [(i, prose(r.randint(1, 25))) for i in range(30)] + [(40, None), (41, "!"), (42, "nowhere"), (43, "the the THE"), (44, "w1"), (44, "w2"), (None, "w3")]
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc int")
    got = ranked_search.search(docs(spark, rows), asked, top, block_terms=block).collect()
    assert sorted([(x.item, x["rank"], x.doc, x.score) for x in got], key=str) == brute_search(rows, items, top)


def test_search_prunes_and_opens_ties():
    """A range that just reaches the limit is opened; one below it isn't."""
    import numpy as np
    import pyarrow as pa

    n = 1_000
    r = random.Random(5)
    times = [r.randint(1, 3) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n, 0, -1), pa.int64()), pa.array([10] * n, pa.int64()), pa.array([[0]] * n, pa.list_(pa.int32())), pa.array([[t] for t in times], pa.list_(pa.int32()))], names=["doc", "n", "terms", "times"])
    q = ranked_search.Queries([b"a"], [0], [np.array([0])], np.array([7]), n, 10 * n)
    segment, best = ranked_search.Segment(batch, q), []
    segment.search(q, 0, best, 20, 1, 0)
    want = sorted(((times[n - d], -d) for d in range(1, n + 1)), reverse=True)[:20]
    assert sorted((-d for _, d, _, _ in best)) == sorted(-d for _, d in want)
    top = max(s for s, *_ in best)
    for limit, count in ((top, min(20, times.count(3))), (top + 1, 0)):
        again: list = []
        segment.search(q, 0, again, 20, limit, 0)
        assert len(again) == count


def test_search_of_empty_tables(spark):
    none, one = docs(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, one).count() == 0
    assert ranked_search.search(docs(spark, [(1, "a", None, None, None)]), one.limit(0)).count() == 0


def brute_dedup(rows):
    """Counter of (doc_id, keep_id, size, kept, digest)."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = Counter()
    for norm, mine in groups.items():
        ordered = sorted(mine, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out.update((r[0], ordered[0][0], len(mine), n == 0, sha(norm)) for n, r in enumerate(ordered))
    return out


@pytest.mark.parametrize(("per_salt", "repeated"), [(4_096, 200_000), (3, 200_000), (2, 0)])
def test_exact_dedup(spark, per_salt, repeated):
    r = random.Random(per_salt)
    text = lambda: "".join(r.choice("ab é\t\n\x0b🙂") for _ in range(r.randint(0, 6)))
    rows = [(i, text(), "en", "s", 0) for i in r.sample(range(10**6), 400)]
    rows += [(-i, " " * (i % 3) + "hot text", "en", "s", 0) for i in range(1, 150)]
    rows += [(None, "hot  text", "en", "s", 0)] * 4 + [(7, "tie", "en", "s", 0)] * 3 + [(8, "t ie", "en", "s", 0)] * 2 + [(None, "none", None, None, None)] * 3
    rows += [(10**7, None, None, None, None), (10**7 + 1, "", None, None, None), (10**7 + 2, "a b" * 300_000, "en", "s", 0), (10**7 + 3, "ab " * 300_000, "en", "s", 0)]
    got = exact_dedup.deduplicated(docs(spark, rows, 4), per_salt=per_salt, max_repeated=repeated).collect()
    assert Counter((x.key, x.keep_id, x.group_size, x.kept, bytes(x.digest).hex()) for x in got) == brute_dedup(rows)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.digest_rows(docs(spark, [])).count() == 0


def test_unequal_texts_of_one_digest_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.unhex(F.lit("00")))
    with pytest.raises(Exception, match="two contents"):
        exact_dedup.deduplicated(docs(spark, [(1, "a", None, None, None), (2, "b", None, None, None)])).collect()
