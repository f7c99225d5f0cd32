import random

from tapeframe.llm import toxicity
from tests.llm import test_decontaminate, test_lines_sharding, test_pieces, test_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "one two three four five six seven eight nine ten eleven"


def corpus():
    r = random.Random(8)
    docs, labels = [], []
    vocabulary = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rstvz"]
    for i in range(240):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["nastiest", "grimmest"]))
        if i % 15 == 1:
            w[5:5] = ITEM.split()
        text = " ".join(w) + ("\nfollow our pages" if i % 3 else "")
        docs.append([i, text, "en", r.choice(["s1", "s1", "s2", None]), len(text)])
        labels.append((i, int(bad)))
    for k in range(12):
        docs.append([300 + k, docs[1 + 4 * (k % 3)][1], "en", "s2", None])
    docs += [[400, None, None, None, None], [401, "", "en", "s1", 0], [None, "no id at all here", "en", "s1", 5], docs[2][:], [402, "x " * 30000, "en", "s1", 60000]]
    r.shuffle(docs)
    return [tuple(d) for d in docs], labels


def brute(spark, docs, labels, items):
    frame = spark.createDataFrame(docs, SCHEMA)
    scorer = toxicity.Scorer(toxicity.learn(spark, frame, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert {"nastiest", "grimmest"} <= set(scorer.lexicon.words)
    kept = [d for d in docs if scorer.score(d[1] or "") < toxicity.THRESHOLD]
    assert len(kept) < len(docs)
    cut = {}
    for row in test_lines_sharding.brute_lines([(k, d[1], d[3], 0) for k, d in enumerate(kept)], 0.05):
        cut[row[0]] = row[1]
    kept = [(d[0], cut[k], *d[2:4]) for k, d in enumerate(kept)]
    label = test_simhash.similar_classes([t for _, t, _, _ in kept])
    one = {}
    for c, d in zip(label, kept):
        one[c] = min(one.get(c, d), d, key=lambda x: (x[0] is None, x[0]))
    assert len(one) < len(kept)
    kept = list(one.values())
    hits = {(i, n, h) for i, n, h, *_ in test_decontaminate.brute([(k, d[1]) for k, d in enumerate(kept)], items) if h}
    gone = {i for i, _, _ in hits}
    assert gone
    return [(d[0], d[1], *d[2:4], None if d[1] is None else test_pieces.LIB.encode(d[1])) for k, d in enumerate(kept) if k not in gone]


def test_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus()
    items = [(1, ITEM), (2, None)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text, r.lang, r.source, r.ids) for r in got), key=repr) == sorted(brute(spark, docs, labels, items), key=repr)
    assert all(r.n_ids == len(r.ids or ()) for r in got)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert name == "sentencepiece" or out.columns == docs.columns
