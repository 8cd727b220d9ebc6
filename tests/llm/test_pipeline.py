import random
import zlib

from test_documents import brute_languages, brute_lines, components_of, measured

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_pipeline(rows):
    """(doc_id, ids_crc32) of the pieces of rows (doc_id, text, lang, source), one document at a time."""
    from tokenizers import Tokenizer

    from tallyleaf.llm import word_ids

    said = brute_languages([(t, lang) for _, t, lang, *_ in rows], [i is not None and zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in rows])
    rows = [r for r, (lang, _, unsure) in zip(rows, said, strict=True) if lang != "und" and not unsure]
    lines = brute_lines([r[:4] for r in rows], 20, 10)
    good = [(r, text) for r, (lost, text) in zip(rows, lines, strict=True) if not measured(r[1])[5] and lost <= 0.8 * measured(r[1])[0]]
    head = components_of([(r[0], text) for r, text in good], 5, 80)
    tool, out = Tokenizer.from_file(word_ids.vocabulary_path("word_bpe_49k.json")), []
    for (i, *_), text in good:
        if i is None or head[i] == i:
            ids = [*tool.encode(text, add_special_tokens=False).ids, 0]
            out += [(i, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048]))) for at in range(0, len(ids), 2048)]
    return sorted(out, key=str)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(23)
    syllables = {"en": ["the", "and", "ing", "ou"], "fr": ["que", "é", "ment", "au"], "fi": ["että", "kk", "uu", "nen"]}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4)))
    text = lambda lang, n: "\n".join(" ".join(word(lang) for _ in range(12)) for _ in range(n))
    rows = [(i, text(lang, r.randint(1, 9)), lang, r.choice(["a", "b", None]), 0) for i in range(70) for lang in [r.choice(list(syllables))]]
    footer = text("en", 1)
    rows += [(100 + i, f"{text('en', 3)}\n{footer}", "en", "a", 0) for i in range(25)]  # the footer goes
    rows += [(150 + i, f"{word('en')}\n{footer}\n{footer.upper()}", "en", "a", 0) for i in range(5)]  # depleted
    for i in range(30):  # exact and near copies
        words = rows[i][1].split(" ")
        if i % 2:
            words[r.randrange(len(words))] = "other"
        rows.append((200 + i, " ".join(words), rows[i][2], rows[i][3], 0))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "12 34", "en", "a", 0), (303, text("fr", 900), "fr", "b", 0), rows[4], (None, rows[5][1], "en", "a", 0)]
    r.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [(x.doc_id, x.ids_crc32) for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    want = brute_pipeline(rows)
    assert sorted(got, key=str) == want and len(want) > 60


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA + ", _k1 int, key string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_does_what_its_stages_do(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    syllables = {"en": ["the", "and", "ing", "ou"], "fr": ["que", "é", "ment", "au"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 60), lang, f"src{i % 2}", 0) for i in range(80) for lang in [r.choice(["en", "fr"])]]
    rows += [(100 + i, rows[i][1], rows[i][2], "src0", 0) for i in range(10)]  # copies
    rows += [(200, "123 456 !", "en", "src0", 0), (201, "the the", "en", "src0", 0), (202, None, None, None, None), (203, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify", "filter_quality", "drop_near_duplicates", "pack"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        sizes.append(docs.count())
    assert sizes == [94, 91, 90, 80]
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {x.doc_id for x in packed} == set(range(80))
    fill = {}
    for x in packed:
        fill[x.sequence_id] = fill.get(x.sequence_id, 0) + x.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
