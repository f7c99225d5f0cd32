import random
import zlib

import pyarrow as pa
import pytest

from tapeframe.llm import toxicity as T

LEX = T.Lexicon({"idiot": 4.0, "vile": 3.0}, {"scumm": 4.0, "räud": 3.5})


def best(text):
    x = T.Scorer(LEX).evidence(text)
    return None if x is None else x[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("What an idiot that was.", 4.0), ("You are an idiot.", 4.0 + T.AIMED), ("He is not an idiot.", 4.0 + T.NEGATED + 0),
        ("She said he was an idiot.", 4.0 + T.REPORTED), ("It was not said. What an idiot.", 4.0), ("No, never; an idiot", 4.0),
        ("I will kill you", T.THREAT), ("kill all of them", T.THREAT), ("to kill time", None), ("I will not kill you", None),
        ("scummy place", 4.0), ("SCUMMERS räudig", 4.0), ("idiotic", None), ("", None), ("not so very far away an idiot", 4.0),
    ],
)
def test_clauses(text, want):
    got = best(text)
    assert (got is None) == (want is None)
    if want is not None and want > 0:
        assert got == pytest.approx(want)
    if want is not None and want <= 0:
        assert got <= 0 and T.Scorer(LEX).score(text) <= 0.5


def test_composition_equals_one_machine_after_the_other():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice(T.ALPHABET) for _ in range(r.randint(0, 12)))
        a, u = T.negation().read(text)
        b, v = T.reported().read(a)
        c, w = T.target().read(b)
        got, weights = T.GRAMMAR.read(text)
        assert got == c and weights == pytest.approx([x + y + z for x, y, z in zip(u, v, w)])


def test_fast_search_finds_what_reading_every_text_finds():
    r = random.Random(2)
    words = ["idiot", "idiots", "scummy", "scum", "RÄUDIGER", "vile", "kill", "you", "the", "x", "é"]
    texts = [" ".join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(r.randint(0, 6))) for _ in range(300)] + [None, ""]
    s = T.Scorer(LEX)
    assert s.scores(pa.array(texts)).tolist() == [T.QUIET if t is None else s.score(t) for t in texts]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n=400):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(30)]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            w.insert(r.randrange(len(w)), r.choice(["nasty", "grim", "foul" + r.choice("abcdefgh")]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_learned_on_what_is_not_held_out(spark):
    docs, labels = corpus()
    flipped = [(i, 1 - y if out(i) else y) for i, y in labels]
    d = spark.createDataFrame([*docs, (None, "nasty grim"), (1000, None), (1001, ""), (1002, "wa " * 60000 + "nasty grim")], "doc_id long, text string").selectExpr("*", "1 as score", "'q' as toxic")
    one, two = (T.learn(spark, d, spark.createDataFrame([*x, (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")) for x in (labels, flipped))
    assert one == two and {"nasty", "grim"} <= set(one.words) and "foul" in one.stems
    got = T.digest(spark, d, one).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == out(r.doc_id) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (1000, 1001)} == {1000: 0, 1001: 0}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.digest(spark, docs, T.learn(spark, docs, none)).collect()] == [T.QUIET]
    assert T.digest(spark, docs.limit(0), T.learn(spark, docs.limit(0), none)).count() == 0


def test_copies_give_support_once(spark):
    docs = [(i, "one odd neighbour") for i in range(50)] + [(100 + i, "plain text") for i in range(50)]
    lex = T.learn(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, toxic int"), None)
    assert not lex.words and not lex.stems


def test_matched_clauses(spark):
    got = T.matched_clauses(spark, spark.createDataFrame([(1, "Fine. You idiot! Bye"), (2, "ok")], "doc_id long, text string"), LEX).collect()
    assert [(r.doc_id, r.clause, r.log_odds) for r in got] == [(1, " You idiot", 5.0)]


def test_held_out_accuracy(spark):
    """Held-out toxic texts that use an insult are found, and clean ones left alone; a few labels are noise."""
    from tapeframe.llm.common import read
    from tapeframe.llm.queries import QUERIES
    from tests.conftest import SF01

    docs = read(spark, SF01, "documents")
    lexicon = T.learn(spark, docs, read(spark, SF01, "labels"))
    got = QUERIES["op1_toxicity"](spark, SF01).join(read(spark, SF01, "labels"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").where("held_out").collect()
    telling = [r for r in got if r.toxic and lexicon.words.keys() & set(T._WORD.findall(r.text.lower()))]
    assert len(telling) > 10 and sum(r.predicted for r in telling) >= 0.95 * len(telling)
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)


def clause_corpus(seed, n):
    """Insults said of someone are toxic; denied and reported ones, and threats without a target, are not."""
    r = random.Random(seed)
    insults = ["nasty", "grim", "vile", "scummy", "rotten"]
    toxic = ["you are {}", "they are {}", "what {} people", "I will kill you", "{} through and through"]
    clean = ["you are not {}", "he said they were {}", "she called him {}", "never {}", "to kill time", "nobody wrote {}"]
    filler = [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(200)]
    out = []
    for i in range(n):
        bad = i % 2
        some = [" ".join(r.choice(filler) for _ in range(8)) for _ in range(4)]
        if bad or r.random() < 0.5:
            for _ in range(2):
                some.insert(r.randrange(5), f"{r.choice(filler)} {r.choice(filler)} {r.choice(filler)} " + r.choice(toxic if bad else clean).format(r.choice(insults)))
        out.append((". ".join(some), bad))
    return out


def test_the_grammar_decides():
    """Negated, reported and aimed clauses change predictions; without the transducers clean texts are flagged."""
    lexicon = T.Lexicon(dict.fromkeys(["nasty", "grim", "vile", "scummy", "rotten"], 3.0), {})
    train, held = clause_corpus(1, 400), clause_corpus(2, 400)

    def measured():
        scorer = T.Scorer(lexicon)
        found = scorer.all_evidence(pa.array([t for t, _ in train]))
        lexicon.coefficients = T.fit([(train[i][1], *x) for i, x in found.items()])
        predicted = scorer.scores(pa.array([t for t, _ in held])) >= T.THRESHOLD
        hit = sum(int(p and y) for p, (_, y) in zip(predicted, held))
        return hit / sum(y for _, y in held), hit / max(int(predicted.sum()), 1)

    recall, precision = measured()
    assert recall > 0.9 and precision > 0.95
    grammar = T.GRAMMAR
    try:
        T.GRAMMAR = T.Transducer(0)
        assert min(measured()) < 0.8
    finally:
        T.GRAMMAR = grammar


def test_long_texts_are_read_clause_by_clause(monkeypatch):
    r = random.Random(7)
    words = ["idiot", "not", "scummy", "RÄUDIGER", "said", "kill", "you", "the", "é", "x" * 30]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", ". ", "\n", "\t"] if i % 3 else [" "]) for _ in range(r.randint(0, 60))) for i in range(200)]
    monkeypatch.setattr(T, "CLAUSE", 80)
    s = T.Scorer(LEX)
    want = [T.QUIET if s.evidence(t) is None else s.score(t) for t in texts]
    monkeypatch.setattr(T.B, "LONG", 0)
    cuts = T.clause_cuts
    monkeypatch.setattr(T, "clause_cuts", lambda d: cuts(d, 100))
    monkeypatch.setattr(T.B, "row_slices", lambda offsets, limit=1: ((i, i + 1) for i in range(len(offsets) - 1)))
    assert s.scores(pa.array(texts)).tolist() == pytest.approx(want)


def test_fit_leaves_its_prior_only_for_evidence():
    assert T.fit([]) == T.Lexicon.coefficients
    one, many = (T.fit([(0, 4.0, 0.0, 1.0)] * n) for n in (1, 50))
    at = lambda w: sum(a * b for a, b in zip(w, (1, 4.0, 0.0, 1.0)))
    assert at(T.Lexicon.coefficients) > at(one) > at(many)


def test_fast_search_splits_words_like_the_grammar():
    lex = T.Lexicon({"idiot": 4.0, "idiota": 4.0, "l'âne": 3.0, "d’oie": 3.0, "σας": 3.0, "i": 3.0}, {"scumm": 4.0, "räud": 3.5, "qu'a": 3.0})
    s, r = T.Scorer(lex), random.Random(4)
    words = ["idiot", "IDIOTA", "l'âne", "L'ÂNE", "d’oie", "scummy", "RÄUDIGER", "qu'anon", "ΣΑΣ", "İ", "kill", "you", "the", "é", "日本", "x²", "7"]
    marks = ["“", "”", "¡", "¿", "«", "»", "\u00a0", "—", "…", "'", "’", "‘", "_", "3", "😀", "\u0301", "·", "。", " ", ""]
    one = [a + w + b for a in marks for w in words for b in marks]
    many = [" ".join(r.choice(marks) + r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 4))) for _ in range(3000)]
    texts = [*one, *many, "", "¡idiota!", "“idiot”"]
    found = set(s.rows(pa.array(texts)).tolist())
    assert not [t for i, t in enumerate(texts) if s.clauses(t) and i not in found]
    assert s.scores(pa.array([*texts, None])).tolist() == [*map(s.score, texts), T.QUIET]


def test_contexts_are_given_on_in_bounded_portions():
    words = ["".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(12_000)]
    texts = [" ".join(words[:9_000]), None, " ".join(words[6_000:])]
    batch = pa.record_batch([pa.array(texts), pa.array([1, 0, 0], pa.int32())], names=["text", "toxic"])
    out = list(T._contexts(iter([batch])))
    assert max(x.num_rows for x in out) < (1 << 16) + len(T.STEM_LENGTHS) + 1
    got = {r for x in out for r in zip(*(c.to_pylist() for c in x.columns))}
    before = lambda own: [T.hash_of(w) for w in ["", *own[:-1]]]
    assert got == {(u, b, toxic) for own, toxic in ((words[:9_000], 1), (words[6_000:], 0)) for w, b in zip(own, before(own)) for u in T.units(w)}
