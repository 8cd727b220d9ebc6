import base64
import hashlib
import io
import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyleaf.llm import preference, url_rules, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, file string, digest string")


def test_archives(spark, tmp_path):
    long = "<p>é</p>" * 40_000
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(30)] + [(90, None, None), (31, "u\r\nX: y", ""), (40, "http://é/", long), (41, "", long), (41, "", long), (7, "http://h/7", "<p>0</p>"), (None, "n", "<p>0</p>")]
    folder = f"file://{tmp_path}/warc"
    done = warc.write(pages(spark, rows), folder)
    assert done.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read(done, folder).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        html = html or ""
        revisit = i is not None and first[html] != i
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if revisit else "response", len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), f"<urn:page:{first[html]}>" if revisit else None, None if revisit else html.encode()))
    shown = lambda rows: sorted(rows, key=str)
    assert shown((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == shown(want)
    assert {r.uri for r in got} >= {"u%0D%0AX:%20y", None, "http://%C3%A9/"}
    assert warc.digest_rows(pages(spark, [])).count() == 0
    broken = next(p for p in (tmp_path / "warc").iterdir() if p.name.endswith(".zst"))
    broken.write_bytes(broken.read_bytes()[:-3])
    with pytest.raises(Exception, match="cut off"):
        warc.read(done, folder).collect()


def test_dictionary_frame_and_malformed_records():
    import zstandard

    samples = [f"WARC/1.1 record number {i} with words in common".encode() * 3 for i in range(300)]
    raw = zstandard.train_dictionary(2048, samples).as_bytes()
    for content in (raw, zstandard.ZstdCompressor().compress(raw)):  # plain, or compressed
        tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        data = warc.SKIPPABLE + len(content).to_bytes(4, "little") + content + tool.compress(samples[0]) + tool.compress(b"")
        assert list(warc.frames(io.BytesIO(data))) == [samples[0], b""]
    with pytest.raises(warc.Malformed):
        list(warc.frames(io.BytesIO(data[:-1])))
    with pytest.raises(warc.Malformed):
        list(warc.frames(io.BytesIO(warc.SKIPPABLE + b"\xff\x00\x00\x00abc")))
    good = warc._record(1, "u", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"payload\r\n", b"paxload\r\n"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), warc._record(1, "u", b"p", 2).replace(b"WARC-Refers-To", b"X-Refers-To")):
        with pytest.raises(warc.Malformed):
            warc.parse(bad)


RULE_CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("http://www.EXAMPLE.org/es/1?q", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/123#f", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com/fr/?u=http://y.com/de/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com?/de/", "x.com", "", None, "allow"),
    ("http://x.org", "x.org", "", None, "allow"),
    ("x.com/de/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b/c://d.org/", "b", "/c://d.org/", None, "allow"),
]


def test_fixed_rules(spark):
    rows = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate([*RULE_CASES, RULE_CASES[0]])], "page_id long, url string, host string")
    none = url_rules.Rules(spark.createDataFrame([], "parts array<string>, key string, confidence double, pages double"), spark.createDataFrame([], "part string, token string"))
    got = {r.page_id: tuple(r)[1:5] for r in url_rules.judge(rows, none).collect()}
    assert [got[i] for i in range(len(RULE_CASES))] == [c[1:] for c in RULE_CASES] and len(got) == len(RULE_CASES) + 1


def written_out(rules):
    """{tokens: (confidence, pages)} of rules, for every choice of tokens, but those of which a part is a rule."""
    members = {}
    for x in rules.members.collect():
        members.setdefault(x.part, []).append(x.token)
    out = {}
    for x in rules.rules.collect():
        for tokens in itertools.product(*(members[p] for p in x.parts)):
            out[tuple(sorted(tokens))] = (round(x.confidence, 6), int(x.pages))
    return {k: v for k, v in out.items() if not any(set(o) < set(k) for o in out)}


def brute_rules(data, least, confidence, longest=99):
    """The same from lists of items: all combinations, shortest first."""
    good, tokens = {}, sorted({x for items in data for x in items} - {url_rules.BAD, url_rules.GOOD})
    has = {t: sum(1 << i for i, d in enumerate(data) if t in d) for t in tokens}
    bad = sum(1 << i for i, d in enumerate(data) if url_rules.BAD in d)
    grown = [((), (1 << len(data)) - 1)]
    for _ in range(longest):
        grown = [((*c, t), m & has[t]) for c, m in grown for t in tokens if (not c or t > c[-1]) and (m & has[t] & bad).bit_count() >= least]
        new = {c: (round((m & bad).bit_count() / m.bit_count(), 6), (m & bad).bit_count()) for c, m in grown if (m & bad).bit_count() >= confidence * m.bit_count()}
        good |= {c: v for c, v in new.items() if not any(set(o) < set(c) for o in good)}
        grown = [(c, m) for c, m in grown if c not in new]
        if not grown:
            break
    return {c: v for c, v in good.items() if not any(set(o) < set(c) for o in good)}


@pytest.mark.parametrize("others", [14, 40])
def test_two_telling_tokens_among_many(spark, others):
    """A and B are half bad each, together always bad; other tokens of the pages are more telling than either."""
    r = random.Random(others)
    rows = []
    for _ in range(2_000):
        a, b = r.random() < 0.5, r.random() < 0.5
        bad = (a and b) or (r.random() < 0.33)
        rows.append([x for x, there in (("A", a), ("B", b)) if there] + [f"t{i}" for i in range(others) if r.random() < (0.26 if bad else 0.2)] + [url_rules.BAD if bad else url_rules.GOOD])
    rules = url_rules.mine(spark.createDataFrame([(x,) for x in rows], "items array<string>"), max_rule=3)
    got = written_out(rules)
    assert got[("A", "B")][0] == 1 and len(rows) > 12
    assert got == brute_rules([set(x) for x in rows], 5, 0.8, 3)


@pytest.mark.parametrize(("wide", "longest"), [(1, 4), (2, 5), (3, 3), (8, 5)])
def test_databases_of_classes_against_brute_force(spark, wide, longest):
    r = random.Random(wide)
    rows = []
    for _ in range(150):
        x = [f"t{i}" for i in range(9) if r.random() < 0.45]
        x += [f"{t}too" for t in x[:3] if t in ("t0", "t4")] + [f"{t}also" for t in x if t == "t5"] * (r.random() < 0.7)
        rows.append([*x, url_rules.BAD if len({"t1", "t2", "t3"} & set(x)) > 1 and r.random() < 0.9 or r.random() < 0.3 else url_rules.GOOD])
    rows += rows[:40] + [[url_rules.BAD]] * 3 + [None]
    rules = url_rules.mine(spark.createDataFrame([(x,) for x in rows], "items array<string>"), 0.02, 4, 0.82, longest, wide)
    want = brute_rules([set(x) for x in rows if x is not None], max(4, 0.02 * (len(rows) - 1)), 0.82, longest)
    assert written_out(rules) == want and len(want) > 5 and max(map(len, want)) > 2


def test_sections_of_many_parts_are_one_rule(spark):
    for n in (50, 400):
        section = lambda c, n=n: "/".join(f"{c}{'x' * (i // 26)}{chr(97 + i % 26)}" for i in range(n))
        rows = [(i, f"http://h{i % 4}.net/{section('a')}/{section('b')}", 1) for i in range(40)]
        rows += [(100 + i, f"http://h{i % 4}.net/{section('ab'[i // 4 % 2])}", 0) for i in range(60)]
        p = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
        labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows], "doc_id long, quality int, toxic int")
        rules = url_rules.mine(url_rules.transactions(p, labels))
        assert [len(x.parts) for x in rules.rules.collect()] == [2] and rules.members.count() == 2 * n
        assert {x.url for x in url_rules.matches(p, rules).collect()} == {u for _, u, b in rows if b}


def test_mined_rules_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(160):
        bad = r.random() < 0.4
        host = r.choice(["pills.net", "casino.net"] if bad and r.random() < 0.9 else ["news.net", "pills.net", "blog.net"])
        rows.append((i, f"http://{host}/{r.choice(['buy', 'read'])}/{i}", int(bad)))
    p = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(900, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows] + [(0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    lists = url_rules.transactions(p, labels)
    got = {(k, *v) for k, v in written_out(url_rules.mine(lists, min_share=0.05, min_pages=5, min_confidence=0.7, max_rule=9)).items()}
    data = [set(x["items"]) for x in lists.collect()]
    need = max(0.05, 5 / len(data)) * len(data)
    good = {}
    for items in data:
        if url_rules.BAD in items:
            for n in range(1, len(items)):
                for c in itertools.combinations(sorted(items - {url_rules.BAD}), n):
                    if c not in good:
                        having = [d for d in data if d >= set(c)]
                        bad = sum(url_rules.BAD in d for d in having)
                        good[c] = (bad / len(having), bad) if bad >= need and bad / len(having) >= 0.7 else None
    rules = {c: v for c, v in good.items() if v}
    minimal = {(c, round(v[0], 6), v[1]) for c, v in rules.items() if not any(set(o) < set(c) for o in rules)}
    assert got == minimal and minimal
    blocked = {x.url for x in url_rules.matches(p, url_rules.mine(lists, 0.05, 5, 0.7, 9)).collect()}
    tokens = {x.url: set(x.t) for x in p.where("url is not null").select("url", url_rules.tokens(F.col("url")).alias("t")).collect()}
    assert blocked == {u for u, t in tokens.items() if any(set(c) <= t for c, _, _ in minimal)}
    assert url_rules.mine(lists.limit(0)).rules.count() == 0


def test_long_and_repeated_urls_are_mined_in_bounded_time(spark):
    """A URL of 40 parts on 5 % of the pages, where each part also comes elsewhere: 2 ** 40 frequent combinations."""
    r = random.Random(3)
    long = "http://long.net/" + "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    rows = [(i, long, int(i % 5 != 0)) for i in range(30)]  # 80 % bad
    rows += [(100 + i, f"http://h{i % 9}.net/part{chr(97 + i % 26)}{'x' * (i % 2)}/z{i}", int(i % 7 == 0)) for i in range(570)]
    rows += [(900, "http://w.net/" + "q/" * 20_000 + "?" + "k=1&" * 5_000, 0)]
    r.shuffle(rows)
    p = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows], "doc_id long, quality int, toxic int")
    began = time.time()
    rules = written_out(url_rules.mine(url_rules.transactions(p, labels), min_share=0.002, min_pages=5))
    assert time.time() - began < 60
    data = [(set(x["items"])) for x in url_rules.transactions(p, labels).collect()]
    assert {("host=long.net",), ("label:long",)} <= set(rules)
    for tokens, (confidence, pages) in rules.items():  # counted over all pages' whole tokens
        having = [d for d in data if d >= set(tokens)]
        assert pages == sum(url_rules.BAD in d for d in having) and abs(confidence - pages / len(having)) < 1e-6 and confidence >= 0.8
    assert rules == brute_rules(data, 5, 0.8, 5)


def rendered(turns):
    out, spans = "", []
    for role, text in turns:
        out += "<|" + (role or "").replace("<|", "< |") + "|>\n"
        body = (text or "").replace("<|", "< |") + "<|end|>\n"
        if role == "assistant":
            spans.append((len(out), len(body)))
        out += body
    return out, spans


def test_preference_pairs(spark):
    u, a = ("user", "hi <|end|>"), ("assistant", "yes 🙂")
    cases = [
        ([u, a], [u, ("assistant", "no")]),
        ([u, a], [u, a]),
        ([u, a, u], [u, a]),
        ([("system", None), u, a], [("system", None), u, ("assistant", None)]),
        (None, [u]),
        ([], []),
        ([(None, "x"), a, a], [(None, "x"), a, u, a]),
        ([("user", "w " * 50_000), a], [("user", "w " * 50_000), a, a]),
    ]
    rows = spark.createDataFrame([(i, c, r, "mine") for i, (c, r) in enumerate(cases)], "n int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r.n: r for r in preference.format_pairs(rows).collect()}
    for i, (c, r) in enumerate(cases):
        c, r = c or [], r or []
        n = next((k for k, (x, y) in enumerate(zip(c, r, strict=False)) if x != y), min(len(c), len(r)))
        g = got[i]
        assert (g.n_prefix, g.prompt) == (n, rendered(c[:n])[0])
        assert (g.chosen_text, [tuple(s) for s in g.chosen_spans]) == rendered(c[n:])
        assert (g.rejected_text, [tuple(s) for s in g.rejected_spans]) == rendered(r[n:])


def test_long_conversations_and_clashing_columns(spark):
    r = random.Random(11)
    turns = [(r.choice(["user", "assistant", None]), r.choice(["a", "bc <|", None, "é🙂"])) for _ in range(3000)]
    other = [*turns[:700], ("assistant", "another"), *turns[701:]]
    rows = spark.createDataFrame([(1, "x", "y", 2, turns, other), (1, "x", "y", 2, turns, other)], "n_prefix int, _a string, _B string, _n int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = preference.format_pairs(rows).collect()
    assert len(got) == 2 and got[0] == got[1] and (got[0]._a, got[0]._B, got[0]._n, got[0].n_prefix) == ("x", "y", 2, 700)
    assert (got[0].chosen_text, [tuple(s) for s in got[0].chosen_spans]) == rendered(turns[700:])
    assert (got[0].rejected_text, [tuple(s) for s in got[0].rejected_spans]) == rendered(other[700:])
    assert preference.format_pairs(rows.limit(0)).count() == 0
    for n in (0, 1, 255, 256, 257, 1000):
        numbers = [r.randint(0, 9) for _ in range(n)]
        found = spark.createDataFrame([(numbers,)], "x array<bigint>").select(preference.sums_before(F.col("x"))).first()[0]
        assert found == [sum(numbers[:i]) for i in range(n)]


def test_swapped_replies_with_ties_and_repeats(spark):
    rows = [(-2, 0, "assistant", "m"), (-1, 0, "assistant", "n"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, None, "assistant", None), (5, 3, None, "t"), (7, 0, "assistant", "alone")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: [tuple(t) for t in x.rejected] for x in preference.swapped_replies(c).collect()}
    assert got == {-2: [("assistant", "n")], -1: [("assistant", "b")], 4: [("user", "q"), ("user", "q"), ("assistant", "a"), ("assistant", None)], 5: [("assistant", "alone"), (None, "t")], 7: [("assistant", "m")]}
    alone = {x.conv_id: [tuple(t) for t in x.rejected] for x in preference.swapped_replies(c.where("conv_id = 7")).collect()}
    assert alone == {7: [("assistant", "alone")]}


def test_all_conversations_with_a_reply_make_a_pair(spark):
    r = random.Random(12)
    rows = [(i, n, r.choice(["user", "assistant", None]), r.choice(["a", "b", None])) for i in r.sample(range(10**9), 300) for n in range(r.randint(1, 4))]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    last = {}
    for i, n, role, text in sorted(rows, key=lambda x: x[:2]):
        if role == "assistant":
            last[i] = text
    order = sorted(last)
    want = {i: last[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    assert {x.conv_id: x.reply for x in preference.next_replies(c).collect()} == want
    assert {x.conv_id for x in preference.digest_rows(c).collect()} == set(want)


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (1, 2, "user", "thanks"), (2, 0, "user", "alone"), (3, 0, "assistant", "a3"), (None, 0, "assistant", "x")]
    c = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: json.loads(r.x) for r in preference.swapped_replies(c).select("conv_id", F.to_json("rejected").alias("x")).collect()}
    assert got == {0: [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a1"}], 1: [{"role": "user", "text": "p"}, {"role": "assistant", "text": "a3"}, {"role": "user", "text": "thanks"}], 3: [{"role": "assistant", "text": "a0"}]}
    assert preference.digest_rows(c.limit(0)).count() == 0
