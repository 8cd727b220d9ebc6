import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyleaf.llm import common, language_id, line_rules, near_dups, order_minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, language int, bucket string, rep int"


def docs(spark, rows):
    """rows (doc_id, text, lang, source), with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 0, "k", 1, "b", 2) for r in rows], SCHEMA)


def prose(r, alphabet, words):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 3))) for _ in range(words)).capitalize() + "."


SYLLABLES = {"aa": ["the", "and", "ing", "ou", "er"], "bb": ["que", "é", "ment", "au", "oi"], "cc": ["sch", "ü", "ung", "der", "ein"], "dd": ["ción", "ñ", "los", "ar", "do"], "ee": ["että", "kk", "uu", "nen", "ssa"]}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 7, 40])
def test_codewords_are_far_apart(n):
    codes = language_id.codewords(n)
    assert len(codes) == n
    for a, b in itertools.combinations(codes, 2):
        assert (a != b).sum() * 2 >= codes.shape[1] - 1 or n <= 2


def test_languages_of_held_out_texts(spark):
    r = random.Random(9)
    rows = [(i, prose(r, SYLLABLES[lang], r.randint(3, 60)), lang, "s") for i in range(400) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", None), (1002, "12 !? 34", None, "s"), (1003, "the and " * 40_000, None, "s"), (None, rows[0][1], rows[0][2], "s"), rows[1]]
    got = language_id.digest_rows(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for i, _, lang, _ in rows[:400]:
        assert by[i].held_out == (__import__("zlib").crc32(str(i).encode()) % 4 == 2)
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in rows[:400] if by[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "aa" and by[None].held_out is False
    kept = language_id.keep_identified(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and {1000, 1001, 1002}.isdisjoint({x.doc_id for x in kept.collect()})


def test_nothing_and_one_language_to_learn_from(spark):
    assert language_id.digest_rows(docs(spark, [])).count() == 0
    unlabelled = docs(spark, [(1, "the and", None, "s")])
    assert language_id.digest_rows(unlabelled).first().lang_pred == "und"
    one = docs(spark, [(i, "the and", "aa", "s") for i in range(9)])
    assert {x.lang_pred for x in language_id.digest_rows(one).collect()} == {"aa"}


def test_calibration_is_over_all_rows(spark):
    r = random.Random(12)
    rows = [("The and the ing", "aa")] * 2_000 + [(prose(r, SYLLABLES[lang], 12), lang) for lang in SYLLABLES for _ in range(60)] + [("", "zz")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
    plain = language_id.Model(model.languages, model.codes, model.weights, np.ones(model.codes.shape[1]), model.trust)
    used = [(t, lang) for t, lang in rows if t]
    margins = plain.margins(pa.array([t.lower().encode() for t, _ in used], pa.binary()))
    assert model.languages == list(SYLLABLES) and np.allclose(model.scales, np.abs(margins).mean(axis=0), rtol=1e-5)
    names = np.array([lang for _, lang in used])
    right = np.stack([((margins[names == x] > 0) == (model.codes[i] > 0)).mean(axis=0) for i, x in enumerate(model.languages)])
    right = np.where(right > 0.5, right, 1e-3)
    assert np.allclose(model.trust, right / right.sum(axis=1, keepdims=True))


def syllables_of(i):
    """Some syllables that a made-up language has for itself."""
    return [a + b for a in "bcdfghjklm" for b in "aeiou"][i % 50 : i % 50 + 1] + [chr(0x4E00 + 7 * i), chr(0x4E03 + 7 * i) + "n", chr(0x4E05 + 7 * i)]


def test_more_languages_than_the_driver_holds_counts_of(spark):
    """The rarest of 620 languages are learnt like the others."""
    r = random.Random(8)
    assert language_id.FEW < 620
    rows = [(prose(r, syllables_of(i), 15), f"l{i}") for i in range(620) for _ in range(2 if i > 500 else 3)] + [("", "zz"), (None, "l1"), ("x", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 620 and model.codes.dtype == np.uint8
    texts = [(prose(r, syllables_of(i), 30), f"l{i}") for i in range(0, 620, 3)]
    best, score, _ = model.decide(pa.array([t.lower().encode() for t, _ in texts], pa.binary()))
    assert np.mean([model.languages[b] == lang for b, (_, lang) in zip(best, texts, strict=True)]) > 0.97 and score.min() > 0 and score.max() <= 1


def test_classifiers_are_the_same_from_the_table(spark):
    r = random.Random(10)
    rows = [(prose(r, SYLLABLES[lang], 12), lang) for lang in SYLLABLES for _ in range(9)]
    counted = {lang: np.sum(list(language_id.counts(pa.array([t.encode() for t, x in rows if x == lang], pa.binary()))), axis=0) for lang in SYLLABLES}
    table = spark.createDataFrame([(lang, int(b), int(c[b])) for lang, c in counted.items() for b in np.flatnonzero(c)], "lang string, bucket int, n long")
    codes = language_id.packed_codewords(len(SYLLABLES))
    plain = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    assert np.allclose(language_id._summed_weights(table, list(SYLLABLES), codes), language_id._held_weights(table, list(SYLLABLES), plain), rtol=1e-4, atol=1e-4)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    r = random.Random(4)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (9, 10, 11, 12, 13, 40)]
    whole = [c.tolist() for c in language_id.counts(pa.array(texts, pa.binary()))]
    monkeypatch.setattr(language_id, "BLOCK", 10)
    for t, want in zip(texts, whole, strict=True):
        assert next(language_id.counts(pa.array([t], pa.binary()))).tolist() == want


def brute_languages(rows, learn):
    """Predictions (language, score, ambiguous) of rows (text, lang), one n-gram at a time."""
    from collections import Counter

    def grams(text):
        raw, out = text.lower().encode(), Counter()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                out[(int.from_bytes(raw[i : i + n], "big") + n) * 0x9E3779B1 % 2**32 >> 19] += 1
        return out

    of = {}
    for (t, lang), use in zip(rows, learn, strict=True):
        if use and t is not None and lang is not None:
            of.setdefault(lang, Counter()).update(grams(t))
    names = sorted(k for k, v in of.items() if v)
    codes = language_id.codewords(len(names))
    share = [{b: (of[x][b] + 0.5) / (sum(of[x].values()) + 0.5 * 8192) for b in range(8192)} for x in names]
    weights = []
    for j in range(codes.shape[1]):
        sides = [[share[i] for i in range(len(names)) if codes[i, j] == s] for s in (1, -1)]
        weights.append([math.log(sum(p[b] for p in sides[0]) / len(sides[0]) + 1e-9) - math.log(sum(p[b] for p in sides[1]) / len(sides[1]) + 1e-9) for b in range(8192)])

    def margins(text):
        g = grams(text)
        return [sum(n * w[b] for b, n in g.items()) / max(1, sum(g.values())) for w in weights]

    learnt = [(margins(t), names.index(lang)) for (t, lang), use in zip(rows, learn, strict=True) if use and t is not None and lang in names]
    scales = [sum(abs(m[j]) for m, _ in learnt) / len(learnt) for j in range(len(weights))]
    trust = []
    for i in range(len(names)):
        mine = [m for m, k in learnt if k == i]
        right = [sum((m[j] > 0) == (codes[i, j] > 0) for m in mine) / len(mine) for j in range(len(weights))]
        right = [x if x > 0.5 else 1e-3 for x in right]
        trust.append([x / sum(right) for x in right])
    out = []
    for t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0, False))
            continue
        m = margins(t)
        loss = [sum(w * math.exp(min(20, max(-20, -3 * m[j] / scales[j] * codes[i, j]))) for j, w in enumerate(trust[i])) for i in range(len(names))]
        best = min(range(len(names)), key=loss.__getitem__)
        second = sorted(loss)[1]
        out.append((names[best], 1 / sum(math.exp(-(x - loss[best])) for x in loss), second - loss[best] < 0.1 * second))
    return out


def test_predictions_against_brute_force(spark):
    r = random.Random(21)
    rows = [(i, prose(r, SYLLABLES[lang], r.randint(1, 30)), lang, "s") for i in range(90) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(200, None, "aa", "s"), (201, "", "aa", "s"), (202, "12 !", "bb", "s"), (203, "the que sch", None, "s"), (204, "x", None, "s"), rows[0], (None, "the and", "aa", None)]
    learn = [not (i is None or __import__("zlib").crc32(str(i).encode()) % 4 == 2) for i, *_ in rows]
    want = brute_languages([(t, lang) for _, t, lang, _ in rows], learn)
    got = sorted((str(x.doc_id), x.lang_pred, round(x.score, 4), x.ambiguous) for x in language_id.digest_rows(docs(spark, rows)).collect())
    assert got == sorted((str(i), lang, round(score, 4), unsure) for (i, *_), (lang, score, unsure) in zip(rows, want, strict=True))


def test_dirty_labels_are_languages_too(spark, monkeypatch):
    """None is left out, whether counts are held or stay a table."""
    rows = [("the and", x) for x in ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + ["d", "e", "f"] + ["c2"] * 2]
    for few in (500, 3):
        monkeypatch.setattr(language_id, "FEW", few)
        model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
        assert model.languages == ["a", "b", "c", "c2", "d", "e", "f"] and (model.codes.dtype == np.uint8) == (few == 3)


def test_a_wrong_bit_is_corrected_and_a_tie_is_flagged():
    codes = language_id.codewords(5)
    bits = codes.shape[1]
    model = language_id.Model(list("abcde"), codes, np.zeros((1, bits)), np.ones(bits), np.full(codes.shape, 1 / bits))
    margins = codes[2].copy()
    margins[0] *= -1
    assert model.losses(margins[None])[0].argmin() == 2
    middle = np.sort(model.losses(((codes[1] + codes[3]) / 2)[None])[0])
    assert middle[1] - middle[0] < language_id.AMBIGUITY * middle[1]


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_base_measures(spark):
    r = random.Random(4)
    pieces = ["a", "b", "cé", "🙂", "#*", "<x>", " ", " ", "\n", "\t", "\x0b", " ", "\r\n", "the end"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 80))) for _ in range(150)]
    texts += [None, "", " \n ", "a b c d e f g h " * 3, "one two three four five six seven eight nine " * 2, "w " * 9, "x" * 5000, " ".join(map(str, range(20_000))), "l1\nl1\n l1\nl1"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in line_rules.digest_rows(docs(spark, rows)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == measured(t), t


def test_frequent_lines_deplete_documents(spark):
    r = random.Random(5)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    common_line = own(30)
    rows = [(i, f"{common_line}\n{own(25)}", "en", "hot") for i in range(8)]
    rows += [(20 + i, f"  {common_line.upper()} \n{own(3)}", "en", "hot") for i in range(2)]  # depleted
    rows += [(30, f"{common_line}\n{own(3)}", "en", "other"), (31, f"{common_line}\n{own(3)}", "en", None)]  # not frequent there
    rows += [(40 + i, f"{(copy := own(40)) if i == 0 else copy}", "en", "hot") for i in range(9)]  # copies of one text count once
    rows += [rows[9], rows[9], (None, None, None, None)]
    got = line_rules.judged(docs(spark, rows), limit=5, text_limit=5).collect()
    assert len(got) == len(rows)
    lost = {}
    for x in got:
        lost.setdefault(x.doc_id, set()).add((x.lost, x.kept))
    assert lost[0] == {(30, True)} and lost[20] == lost[21] == {(30, False)}
    assert lost[30] == lost[31] == {(0, True)} and lost[40] == {(0, True)} and lost[None] == {(0, False)}
    kept = line_rules.keep_good(docs(spark, rows), limit=5, text_limit=5)
    assert kept.columns == docs(spark, []).columns
    cleaned = {x.doc_id: x for x in kept.collect()}
    assert cleaned[0].text == rows[0][1].split("\n")[1] and cleaned[0].n_chars == len(cleaned[0].text)  # the line is gone
    assert cleaned[30].text == rows[10][1] and cleaned[30].n_chars == 0 and {20, 21, None}.isdisjoint(cleaned)
    assert line_rules.digest_rows(docs(spark, [])).count() == 0 and line_rules.keep_good(docs(spark, [])).count() == 0


def brute_lines(rows, limit, text_limit):
    """Lost words and cleaned text of rows (doc_id, text, lang, source), one document at a time."""
    lines = lambda t: [(i, x, re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")) for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    has, out = {}, []
    for i, t, _, host in set(rows):
        for _, _, n in lines(t):
            has.setdefault((host, n), set()).add((i, t))  # rows of one id are one document
    texts = {k: {tuple(n for *_, n in lines(t)) for _, t in v} for k, v in has.items()}
    for _, t, _, host in rows:
        gone = {i: x for i, x, n in lines(t) if len({k if k is not None else (k, y) for k, y in has[host, n]}) > limit and len(texts[host, n]) > text_limit}
        out.append((sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in gone.values()), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)))
    return out


@pytest.mark.parametrize("text_limit", [0, 3])
def test_lines_against_brute_force(spark, text_limit):
    r = random.Random(15)
    pool = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randint(1, 9))) for _ in range(30)] + ["", " ", "\t x ", "X", "\x0b"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 8))), "en", r.choice(["a", "b", "", None])) for i in range(150)]
    rows += [(200 + i, rows[3][1], "en", rows[3][3]) for i in range(30)] + [rows[0], rows[0], (None, rows[1][1], None, None), (None, None, None, None), *[(77, f"{pool[0]}\nown {i}", "en", "a") for i in range(9)], (400, "line\n" * 5_000 + "x" * 50_000, "en", "a")]
    got = {}
    for x in line_rules.judged(docs(spark, rows), limit=6, text_limit=text_limit).collect():
        got.setdefault((x.doc_id, x.n_words), set()).add(x.lost)
    want = brute_lines(rows, 6, text_limit)
    for (i, t, *_), (lost, _) in zip(rows, want, strict=True):
        assert lost in got[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))]
    assert sum(lost > 0 for lost, _ in want) > 50
    kept = {x.doc_id: x.text for x in line_rules.keep_good(docs(spark, rows), limit=6, text_limit=text_limit).collect()}
    cleaned = {i: text for (i, *_), (_, text) in zip(rows, want, strict=True)}
    assert len(kept) > 20 and all(text == cleaned[i] for i, text in kept.items())


def test_copies_are_no_boilerplate(spark):
    r = random.Random(8)
    lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(4)]
    shapes = [lambda x, i: x + "\t" * i, lambda x, i: x.upper() + " " * i, lambda x, i: x.replace(" ", " " * (2 + i)), lambda x, i: " " * (i + 1) + x, lambda x, i: "\t" * (i + 1) + x]
    rows = [(i, "\n".join(shapes[i % 5](x, i // 5) for x in lines) + "\n" * (i // 10), "en", "hot") for i in range(25)]
    assert len({t for _, t, *_ in rows}) > line_rules.LINE_LIMIT
    kept = line_rules.keep_good(docs(spark, rows), text_limit=10)
    assert {x.doc_id for x in kept.collect()} == set(range(25))
    judged = lambda rows, **limits: {x.kept for x in line_rules.judged(docs(spark, rows), **limits).collect()}
    assert judged(rows, text_limit=10) == {True} and judged(rows) == {False}
    # Copies and other pages: 21 documents have the line, of more different texts than the limit.
    mixed = [(i, lines[0] if i < 10 else f"{lines[0]}\nown{i}", "en", "hot") for i in range(21)]
    assert judged(mixed, text_limit=10) == judged(mixed) == {False}
    # Near copies with a word of their own are other texts: their common lines go.
    near = [(i, "\n".join([*lines, f"own{i}"]), "en", "hot") for i in range(25)]
    assert line_rules.keep_good(docs(spark, near), text_limit=10).count() == 0
    # The footer of a host with ten templates, and rows that are one document.
    ten = [(i, f"{lines[0]} {i % 10}\nthe footer of all", "en", "hot") for i in range(100)]
    assert {x.lost for x in line_rules.judged(docs(spark, ten)).collect()} == {4} and {x.lost for x in line_rules.judged(docs(spark, ten), text_limit=10).collect()} == {0}
    assert {x.lost for x in line_rules.judged(docs(spark, [(5, t, lang, host) for _, t, lang, host in ten])).collect()} == {0}


def test_stages_leave_columns_named_as_their_helpers_alone(spark):
    r = random.Random(13)
    rows = [(i, prose(r, SYLLABLES[lang], 40), lang, "s", f"l{i}", f"k{i}", i) for i in range(60) for lang in [r.choice(["aa", "bb"])]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _language string, _K1 string, _places int")
    for stage in (language_id.keep_identified, line_rules.keep_good, near_dups.keep_first):
        kept = stage(table)
        assert kept.columns == table.columns
        found = {tuple(x) for x in kept.collect()}
        assert len(found) > 50 and found <= set(rows), stage


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components_of(rows, size, percent):
    sets = [(k, shingles(t, size)) for k, t in rows]
    head = {k: k for k, _ in rows if k is not None}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = top(a), top(b)
            head[max(a, b)] = min(a, b)
    return {k: top(k) for k in head}


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 90)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    r = random.Random(size)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(10):
        base = [word() for _ in range(r.choice([3, 8, 30, 120, 400]))]
        for _ in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([*passage, *[word() for _ in range(r.randint(2, 40))]]) for _ in range(25)]  # most of each is shared
    chain = [word() for _ in range(100)]
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 4)]
    texts += [None, "", " \t ", "One two", "one  TWO", "one", "É a b c d e", "é a b c d e", texts[0], texts[0].upper(), "long " * 20_000, " ".join(f"u{i}" for i in range(5000))]
    r.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[5])]
    found = near_dups.near_duplicates(docs(spark, [(k, t, "en", "s") for k, t in rows]), size, percent).collect()
    want = components_of(rows, size, percent)
    assert len(found) == len(rows)
    for x in found:
        assert x.component_id == (None if x.key is None else want[x.key])
    assert {x.key: x.n_shingles for x in found if x.key is not None} == {k: len(shingles(t, size)) for k, t in rows if k is not None}
    kept = near_dups.keep_first(docs(spark, [(k, t, "en", "s") for k, t in rows]), size, percent)
    assert {x.doc_id for x in kept.collect()} == {None, *want.values()} and kept.columns == docs(spark, []).columns


def brute_shared(rows, size, percent):
    """Component by key, where rows that share a key are one document; (key, text)."""
    sets, head = [shingles(t, size) for _, t in rows], {k: k for k, _ in rows}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                p, q = top(a), top(b)
                head[max(p, q)] = min(p, q)
    return {k: top(k) for k in head}


def test_rows_that_share_a_key_connect_what_they_are_like(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(12)) for c in "xyz")
    rows = [(1, x), (2, x), (2, y), (3, y), (4, z), (4, None), (5, z), (6, ""), (6, y)]
    got = near_dups.near_duplicates(docs(spark, [(k, t, "en", "s") for k, t in rows]), 4).collect()
    assert {(r.key, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (6, 1), (4, 4), (5, 4)} and len(got) == len(rows)
    r = random.Random(17)
    base = [[f"b{b}w{i}" for i in range(30)] for b in range(25)]
    rows = [(r.randrange(40), " ".join(edited(r, r.choice(base), r.choice([0, 0, 1, 2, 3])))) for _ in range(70)] + [(3, None), (3, "a b"), (9, ""), (100, None)]
    for retained in (near_dups.K, None):
        got = near_dups.near_duplicates(docs(spark, [(k, t, "en", "s") for k, t in rows]), 4, retained=retained).collect()
        assert {(x.key, x.component_id) for x in got} == set(brute_shared(rows, 4, 80).items()) and len(got) == len(rows)


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_words_across_blocks(monkeypatch, block):
    r = random.Random(block)
    texts = ["".join(r.choice("ab é \n🙂Z") for _ in range(n)) for n in (0, 1, 2, 3, 14, 15, 100, 300)] + ["x" * 50, " " * 50, "ab " * 20]
    whole = [near_dups.word_hashes(t.encode()) for t in texts]
    monkeypatch.setattr(near_dups, "BLOCK", block)
    for t, want in zip(texts, whole, strict=True):
        assert near_dups.word_hashes(t.encode()).tolist() == want.tolist() and len(want) == len(re.findall(r"[^\x20\x09-\x0D]+", t))


def edited(r, words, edits):
    """A copy with so many words replaced, left out, doubled or swapped."""
    out = list(words)
    for _ in range(edits):
        i = r.randrange(len(out) - 1)
        kind = r.randrange(4)
        out[i : i + 2] = [[f"e{r.randrange(10**6)}", out[i + 1]], [out[i + 1]], [out[i], out[i], out[i + 1]], [out[i + 1], out[i]]][kind]
    return out


@pytest.mark.parametrize("structured", [False, True])
def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, structured):
    """Copies of one text of 40 words with two edits each, most of which aren't similar to it."""
    exact, counted = near_dups._exact, []
    monkeypatch.setattr(near_dups, "_exact", lambda pairs, sets: counted.append(pairs.count()) or exact(pairs, sets))
    total = {}
    for n in (400, 1600):
        r = random.Random(31)
        base = [f"w{i}" for i in range(40)]
        texts = []
        for _ in range(n):
            if structured:
                texts.append(" ".join(edited(r, base, 2)))
            else:
                copy = list(base)
                for i in r.sample(range(40), 2):
                    copy[i] = f"e{r.randrange(10**6)}"
                texts.append(" ".join(copy))
        rows = list(enumerate(texts))
        counted.clear()
        found = near_dups.near_duplicates(docs(spark, [(k, t, "en", "s") for k, t in rows]), 4).collect()
        total[n] = sum(counted)
        assert {x.key: x.component_id for x in found} == fast_components(rows, 4)
    assert total[1600] < 5 * total[400] and total[1600] < 6 * 1600


def fast_components(rows, size):
    """As components_of at 80 %, from the smallest possible differences up: sets as bit masks of numbered shingles."""
    number, masks = {}, []
    for k, t in rows:
        masks.append((k, sum(1 << number.setdefault(s, len(number)) for s in shingles(t, size))))
    head = {k: k for k, _ in rows}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, x) in enumerate(masks):
        for b, y in masks[:i]:
            if 100 * (x & y).bit_count() >= 80 * (x | y).bit_count():
                p, q = top(a), top(b)
                head[max(p, q)] = min(p, q)
    return {k: top(k) for k in head}


def test_recall_near_the_threshold(spark):
    """Pairs at 0.80 to 0.82, of equal sizes and one inside the other, from 30 to 2,000 shingles: all are found, by sketches and by whole sets."""
    r = random.Random(41)
    rows, links = [], 0
    for n in (30, 60, 150, 400, 1000, 2000):
        for _ in range(20):
            words = [f"w{r.randrange(10**7)}" for _ in range(n + 3)]
            if r.random() < 0.5:
                other = words[: int((n + 3) * r.choice([0.8, 0.81, 0.82])) + 1]
            else:
                cut = int(n * r.choice([0.1, 0.105, 0.11]))
                other = words[cut:] + [f"x{r.randrange(10**7)}" for _ in range(cut)]
            a, b = shingles(" ".join(words), 4), shingles(" ".join(other), 4)
            links += 100 * len(a & b) >= 80 * len(a | b)
            rows += [(2 * len(rows), " ".join(words)), (2 * len(rows) + 1, " ".join(other))]
    want = components_of(rows, 4, 80)
    table = docs(spark, [(k, t, "en", "s") for k, t in rows])
    for retained in (near_dups.K, None):
        assert {x.key: x.component_id for x in near_dups.near_duplicates(table, 4, retained=retained).collect()} == want
    assert links > 90


def test_marks_differ_by_no_more_than_sets():
    r = np.random.default_rng(5)
    for n in (3, 40, 700):
        a = np.unique(r.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate([a[n // 10 :], r.integers(-(2**63), 2**63 - 1, n // 7)]))
        bits = int(np.unpackbits((near_dups.parity_marks(a) ^ near_dups.parity_marks(b)).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0 or n < 10)


def test_no_documents_and_components(spark, tmp_path):
    assert near_dups.near_duplicates(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_dups.near_duplicates(docs(spark, []), percent=50)
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = near_dups.components(spark.createDataFrame(path, "a long, b long"), f"file://{tmp_path}").collect()
    assert dict(got) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_fingerprints_of_edited_texts(spark):
    r = random.Random(3)
    texts = [prose(r, SYLLABLES[r.choice(list(SYLLABLES))], r.randint(1, 200)) for _ in range(60)] + [None, "", "a", "ab🙂", "x" * 500, "long text " * 20_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(7, "repeated id", "en", "s"), (None, "no id", "en", "s")]
    got = order_minhash.digest_rows(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted([(i, t or "") for i, t, *_ in rows if i is not None], key=lambda x: (-x[0], x[1])) + [(None, "no id")]
    want = []
    for n, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(n + 1) % len(order)][1]
        edited = t[: len(t) - half] + after[:half]
        sign = lambda x: order_minhash.signature(x).tobytes().hex()
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sign(t), sign(edited), round(float((order_minhash.signature(t) == order_minhash.signature(edited)).mean()), 6), round(float((order_minhash.signature(t) == order_minhash.signature(after)).mean()), 6)))
    shown = [(x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 6), round(x.near_next, 6)) for x in got]
    assert sorted(shown, key=str) == sorted(want, key=str)
    for one in ([], [(5, "only one", "en", "s")]):
        assert order_minhash.digest_rows(docs(spark, one)).count() == len(one)
    assert {x.fingerprint for x in order_minhash.fingerprints(docs(spark, rows)).collect()} == {w[3] for w in want}


@pytest.mark.parametrize("kind", ["one id", "no id", "one row"])
def test_equal_ids_are_dealt(spark, kind):
    """All rows share an id (or have none): they still go to several tasks, and each is followed by another one."""
    texts = [f"text number {0 if kind == 'one row' else i} of many" for i in range(90)]
    table = docs(spark, [(None if kind == "no id" else 5, t, "en", "s") for t in texts]).repartition(5).cache()
    placed = order_minhash.with_next(table, "doc_id", "text").groupBy("bucket").agg(F.count_if("guest").alias("guests"), F.count_if(~F.col("guest")).alias("rows")).collect()
    assert len(placed) == 2 and {p.guests for p in placed} == {1} and max(p.rows for p in placed) < 60
    got = order_minhash.digest_rows(table).collect()
    edits = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a in texts for b in texts}
    assert len(got) == 90 and {x.edited_sha256 for x in got} <= edits
    assert sorted(x.fingerprint for x in got) == sorted(order_minhash.signature(t).tobytes().hex() for t in texts)


def test_long_texts_are_signed_in_blocks(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("ab é🙂") for _ in range(n)) for n in (0, 5, 8, 63, 64, 65, 200, 999)] + ["a" * 700, "ab" * 300 + "".join(r.choice("xyz") for _ in range(90))]
    whole = [order_minhash.signature(t).tolist() for t in texts]
    monkeypatch.setattr(order_minhash, "BLOCK", 64)
    for t, want in zip(texts, whole, strict=True):
        assert order_minhash.signature(t).tolist() == want == brute_signature(t), len(t)


def test_memory_of_long_texts():
    import tracemalloc

    r = random.Random(6)
    text = " ".join(f"{r.randrange(10**6)}" for _ in range(1_000_000))
    for run in (lambda: order_minhash.signature(text), lambda: near_dups.shingle_hashes(text.encode(), 5), lambda: list(language_id.counts(pa.array([text.encode()], pa.binary())))):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 20 * len(text) + (180 << 20)
        tracemalloc.stop()


def brute_signature(text):
    """The definition, one function at a time, without limits or blocks."""
    h = order_minhash.kmers(text)
    seen, x = {}, []
    for v in h.tolist():
        n = seen.get(v, 0)
        seen[v] = n + 1
        x.append(v if n == 0 else int(order_minhash._mixed(np.array([v], np.uint64) + np.uint64(n) * order_minhash.R)[0]))
    out = []
    for f in order_minhash.FUNCTIONS.tolist():
        chosen = sorted(sorted(range(len(x)), key=lambda i: (x[i] * f) % 2**64)[: order_minhash.TUPLE])
        total = np.array([len(x) if 0 < len(x) < order_minhash.TUPLE else 0], np.uint64)
        for i in chosen:
            total = order_minhash._mixed(total * order_minhash.R + h[i : i + 1])
        out.append(int(total[0] >> np.uint64(48)) if chosen else 0)
    return out


def test_signature_is_its_definition_and_falls_with_edits():
    r = random.Random(1)
    for n in (0, 1, 7, 8, 9, 12, 30, 300, 3000):
        text = "".join(r.choice("ab é") for _ in range(n))
        assert order_minhash.signature(text).tolist() == brute_signature(text), n
    text = prose(r, SYLLABLES["aa"], 400)
    near = [order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(text[:cut] + prose(r, SYLLABLES["bb"], 300)[: len(text) - cut])) for cut in (len(text), len(text) * 9 // 10, len(text) // 2, 0)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] == 0
    half = len(text) // 2
    assert order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(text[half:] + text[:half])) < 0.9  # order counts


def test_equal_leading_bits_are_no_equal_hashes():
    """Hashes that differ in their last bits alone are other k-mers, however long the text is."""
    h = np.array([1 << 40, (1 << 40) + 1, 1 << 40, (1 << 40) + 2, 5, 5], dtype=np.uint64)
    got = order_minhash.numbered(h)
    assert (got[[0, 1, 3, 4]] == h[[0, 1, 3, 4]]).all() and (got[[2, 5]] != h[[2, 5]]).all()
    again = order_minhash._mixed(h[[2, 5]] + order_minhash.R)
    assert (got[[2, 5]] == again).all()


def brute_kmers(text):
    """From the text itself, one k-mer at a time; a shorter text is one, of all its code points."""
    mask, r = 2**64 - 1, int(order_minhash.R)

    def mixed(x):
        x = (x ^ (x >> 30)) * int(order_minhash.MIX_A) & mask
        x = (x ^ (x >> 27)) * int(order_minhash.MIX_B) & mask
        return x ^ (x >> 31)

    points = [ord(c) + 1 for c in text]
    if 0 < len(points) < 8:
        total = len(points)
        for p in points:
            total = mixed((total * r + p) & mask)
        return [total]
    return [mixed(sum(p * r**j for j, p in enumerate(points[i : i + 8])) & mask) for i in range(len(points) - 7)]


def test_short_texts_are_read_to_their_end():
    r = random.Random(7)
    for n in range(10):
        text = "".join(r.choice("ab é🙂") for _ in range(n))
        assert order_minhash.kmers(text).tolist() == brute_kmers(text), n
    for n in range(2, 10):
        text = "".join(r.choice("ab é🙂") for _ in range(n))
        for place in range(n):
            other = text[:place] + "z" + text[place + 1 :]
            assert order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(other)) < 1, (n, place)
    assert order_minhash.likeness(order_minhash.signature("Ereaea."), order_minhash.signature("EreaEnb")) == 0


def test_order_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("key"))
    bounds = common.order_bounds(df, "key", 8)
    counts = [r["count"] for r in df.groupBy(common.order_bucket(F.col("key"), bounds).alias("b")).count().orderBy("b").collect()]
    assert len(bounds) == 7 and len(counts) == 8 and max(counts) < 200
