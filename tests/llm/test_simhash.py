import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tapeframe.llm import simhash as S

SCHEMA = "doc_id long, text string"


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    """Smallest index reachable, by comparing all pairs."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = classes(fps)
    out = []
    for (i, _), f, c in zip(rows, fps, label):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None]
        out.append((i, f"{f:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "日本"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 60, 200])))) for i in range(40)]
    long = [r.choice(vocabulary) for _ in range(900)]
    for i in range(40, 90):
        x = list(long)
        for _ in range(r.randint(0, 3)):
            x[r.randrange(len(x))] = "new"
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(x)))
    rows += [(100, None), (101, ""), (102, " \n"), (None, "w1 w2 w3"), (103, "W1 w2\tW3"), (None, "only null here"), (40, rows[40][1]), (5, rows[5][1])]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fp", "2 as component_id").repartition(3)
    assert sorted(map(tuple, S.digest(S.near_duplicates(spark, docs)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a")]])
def test_small_tables(spark, rows):
    assert sorted(map(tuple, S.digest(S.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA))).collect()), key=repr) == brute(rows)


def cluster(seed, n, flips):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    chain = r.getrandbits(64)
    for _ in range(n):
        for _ in range(flips):
            chain ^= 1 << r.randrange(64)
        out.add(chain)
    return sorted(out)


def test_trees_find_all_within_radius():
    values = np.array(cluster(1, 300, 2), np.uint64)
    group = np.sort(np.random.default_rng(0).integers(0, 3, len(values)))
    got = {(a, b) for x, y in S.Forest(group, values).within(np.arange(len(values))) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if group[a] == group[b] and (int(values[a]) ^ int(values[b])).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize(("shard", "frontier"), [(4096, 1 << 20), (2, 7)])
def test_links_connect_what_pairs_connect(spark, monkeypatch, shard, frontier):
    """With tiny shards all go the way of the large ones."""
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "FRONTIER", frontier)
    values = cluster(2, 120, 2) + cluster(4, 40, 1)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = S.links(spark, spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = dict(map(tuple, S.components(spark, edges).collect()))
    label = classes(values)
    for i in range(len(values)):
        for j in range(i):
            assert (label[i] == label[j]) == (found.get(signed[i], signed[i]) == found.get(signed[j], signed[j]))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar_classes(texts):
    """Smallest index reachable over pairs of five-word similarity 0.8, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if label[j] < label[i] and len(x & y) >= 0.8 * len(x | y):
                    label[i], changed = label[j], True
    return label


def test_similar_groups(spark):
    r = random.Random(9)
    vocabulary = [f"word{i}" for i in range(2000)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 30, 200])))) for i in range(60)]
    for i in range(60, 120):
        x = rows[r.randrange(40)][1].split()
        for _ in range(len(x) // 150):
            x[r.randrange(len(x))] = "changed"
        rows.append((i, " ".join(x)))
    rows += [(200, None), (201, ""), (202, " "), (None, rows[3][1]), (None, "alone of all"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = similar_classes([t for _, t in rows])
    want = {}
    for c, (i, _) in zip(label, rows):
        want.setdefault(c, []).append(i)
    got = {}
    for x in S.similar_groups(spark, docs).collect():
        got.setdefault(x.centre, []).append(x.doc_id)
    parts = lambda groups: sorted((sorted(v, key=repr) for v in groups.values()), key=repr)
    assert parts(got) == parts(want)
    kept = [x.doc_id for x in S.representatives(spark, docs).collect()]
    assert sorted(kept, key=repr) == sorted((min(v, key=lambda i: (i is None, i)) for v in want.values()), key=repr)


def rows_of(seed=7, n=80):
    """(fp, s1, s2, n, centre) of rows with near fingerprints, near and far screens, and repeated ones, sorted."""
    r = random.Random(seed)
    values = cluster(seed, n, 4) + [77] * 9
    screens = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(2)]
    out = []
    for v in values:
        a, b = screens[r.randrange(2)]
        for _ in range(r.randrange(30)):
            a ^= 1 << r.randrange(64)
        out.append((v, a, b, r.choice([90, 95, 100, 130]), r.randrange(12)))
    return out + out[:5]


def near(x, y):
    return (x[0] ^ y[0]).bit_count() <= 6 and (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count() <= S.SCREEN and min(x[3], y[3]) >= 0.8 * max(x[3], y[3])


def columns(rows):
    return [np.array([r[c] for r in rows], np.uint64 if c < 3 else np.int64) for c in range(5)]


def reachable(n, pairs):
    pairs = list(pairs)
    return S.smallest_reachable(n, iter(pairs)).tolist()


def test_spanning_pairs_connect_what_is_near():
    rows = sorted(rows_of())
    fp, s1, s2, n, _ = columns(rows)
    want = reachable(len(rows), [(np.array([i]), np.array([j])) for i in range(len(rows)) for j in range(i) if near(rows[i], rows[j])])
    pairs = list(S.spanning(np.zeros(len(rows), np.int64), fp, s1, s2, n))
    assert reachable(len(rows), pairs) == want and sum(len(a) for a, _ in pairs) == len(rows) - len(set(want))


@pytest.mark.parametrize("frontier", [1 << 20, 5])
def test_proposed_pairs_are_all_pairs_between_groups(monkeypatch, frontier):
    monkeypatch.setattr(S, "FRONTIER", frontier)
    rows = sorted(rows_of(6, 40) * 2, key=lambda x: (x[0], x[4]))
    fp, s1, s2, n, centre = columns(rows)
    got = sorted((min(x, y), max(x, y)) for i, j in S.proposed(np.zeros(len(rows), np.int64), fp, s1, s2, n, centre) for x, y in zip(i.tolist(), j.tolist()))
    want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][4] != rows[j][4] and near(rows[i], rows[j])]
    assert got == want


@pytest.mark.parametrize("shard", [4096, 3])
def test_pairs_meet_in_shards_and_their_parts(spark, monkeypatch, shard):
    """With tiny shards all are dealt again."""
    monkeypatch.setattr(S, "SHARD", shard)
    rows = rows_of(5, 60)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = [(*map(signed, r[:3]), r[3], t, r[4]) for t, r in enumerate(rows)]
    vertices = spark.createDataFrame(table, "fp long, s1 long, s2 long, n long, t long, centre long")
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near(rows[i], rows[j])}
    found = [(np.array([r.a]), np.array([r.b])) for r in S.spanning_pairs(spark, vertices.drop("centre")).collect()]
    assert reachable(len(rows), found) == reachable(len(rows), [(np.array([i]), np.array([j])) for i, j in want])


@pytest.mark.parametrize("portion", [512, 4])
def test_links_within_trees(spark, monkeypatch, portion):
    """All pairs of a tree are decided, in one portion or in several that meet two at a time."""
    monkeypatch.setattr(S, "PORTION", portion)
    r = random.Random(3)
    rows, sets = [], []
    for t in range(40):
        base = 1000 * (t % 3)
        x = np.unique(np.array([base + k if r.random() < 0.93 else 5000 + r.randrange(1000) for k in range(40)], np.uint32))
        sets.append(set(x.tolist()))
        rows.append((t % 2, 5 ^ (1 << t % 4), 0, 0, len(x), t, t - t % 4, bytearray(x.tobytes())))
    table = spark.createDataFrame(rows, "tree long, fp long, s1 long, s2 long, n long, t long, centre long, s binary")
    got = S.links_within(spark, table).collect()
    names = sorted({x[6] for x in rows})
    at = {c: i for i, c in enumerate(names)}
    pairs = [(at[x[6]], at[y[6]]) for x in rows for y in rows if x[0] == y[0] and len(sets[x[5]] & sets[y[5]]) >= 0.8 * len(sets[x[5]] | sets[y[5]])]
    arrays = lambda ps: [(np.array([a for a, _ in ps]), np.array([b for _, b in ps]))] if ps else []
    assert got and reachable(len(names), arrays([(at[x.a], at[x.b]) for x in got])) == reachable(len(names), arrays(pairs))


def test_similar_texts_are_within_the_screen():
    """Of random pairs with a similarity of 0.8 or a little more none is screened away, few shingles or many."""
    r = random.Random(4)
    for size in [9, 14, 30, 100, 400]:
        for _ in range(60):
            x = [f"w{r.randrange(10**6)}" for _ in range(size)]
            y = list(x)
            while True:
                z = list(y)
                z[r.randrange(size)] = f"v{r.randrange(10**6)}"
                a, b = shingles(" ".join(x)), shingles(" ".join(z))
                if len(a & b) < 0.8 * len(a | b):
                    break
                y = z
            data = [np.frombuffer(" ".join(t).encode(), np.uint8) for t in (x, y)]
            _, p, q, n, _ = (np.concatenate(c) for c in zip(*(S._described(d, np.array([0, len(d)])) for d in data)))
            assert int(p[0] ^ p[1]).bit_count() + int(q[0] ^ q[1]).bit_count() <= S.SCREEN
            assert n.tolist() == [len(shingles(" ".join(t))) for t in (x, y)]


def test_long_texts_go_part_by_part(monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice(["A", "bc", "Déf", "x" * 50]) for _ in range(k)) + r.choice(["", " "]) for k in [0, 1, 2, 3, 4, 5, 9, 60]]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        want = [S._described(data, np.array([0, len(data)])), S._fingerprints, [b.to_pydict() for b in S._shingle_sets(iter([pa.RecordBatch.from_pydict({"t": [1], "text": [t]})]))]]
        whole = fingerprint(t)
        with monkeypatch.context() as m:
            m.setattr(S.B, "LONG", 0)
            m.setattr(S, "HELD", 40)
            pieces = S.B.pieces
            m.setattr(S.B, "pieces", lambda d, table, limit=13, overlap=0: pieces(d, table, limit, overlap))
            if len(data):
                assert S.long_fingerprint(data) == whole
                assert [x.tolist() for x in S._described(data, np.array([0, len(data)]))] == [x.tolist() for x in want[0]]
            assert [b.to_pydict() for b in S._shingle_sets(iter([pa.RecordBatch.from_pydict({"t": [1], "text": [t]})]))] == want[2]


def test_representatives_keep_any_columns(spark):
    """Rows of one id and text that differ elsewhere: always the same one stays; names may clash with the operator's own."""
    rows = [(1, "a b c d e f", "s1", 5, 7), (1, "a b c d e f", "s2", 5, 7), (1, "a b c d e f", "s2", 5, 7), (2, "other words", "s1", None, 1), (None, "other words", "s1", None, 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __key long, centre long").selectExpr("*", "1 as k1", "2 as `row`", "map(1, 2) as m", "3 as `a.b`")
    got = [S.representatives(spark, docs.repartition(k)) for k in (1, 3)]
    assert got[0].schema == docs.schema
    first, second = (sorted(map(repr, g.collect())) for g in got)
    assert first == second and len(first) == 3


def test_similar_groups_of_texts_with_one_vocabulary(spark):
    """Nearer texts in another order stand between two copies; both copies are still one group."""
    r = random.Random(12)
    rows = []
    for g in range(10):
        copy = [f"w{g}.{i}" for i in range(150)]
        again = list(copy)
        again[70], again[71] = again[71], again[70]
        late = [*copy[:140], "new", *copy[141:]]
        group = [copy, again, late] + [r.sample(copy, len(copy)) for _ in range(20 if g == 3 else 4)]
        rows += [(100 * g + k, " ".join(x)) for k, x in enumerate(group)]
    rows += [(5000, ""), (5001, " "), (5002, "\n\n"), (5003, rows[0][1].upper().replace(" ", "  "))]
    got = {x.doc_id: x.centre for x in S.similar_groups(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    label = similar_classes([t for _, t in rows])
    for i in range(len(rows)):
        for j in range(i):
            assert (label[i] == label[j]) == (got[rows[i][0]] == got[rows[j][0]])
