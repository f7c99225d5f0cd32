"""Folds and graph algorithms against brute force and known cases."""

import itertools
import random

import numpy as np
import pytest

from tapeframe.operators import sequence as S


def test_refused_joins():
    u = S.Clusters("AABBC")
    assert u.join(0, 2) and not u.join(0, 1) and not u.join(1, 2) and u.refused == 2 and u.linked == 1
    assert u.join(0, 4) and u.of[4] == u.of[2] and u.of[1] != u.of[0]


def test_joins_against_sets():
    r = random.Random(5)
    for _ in range(50):
        caps = [r.randrange(5) for _ in range(20)]
        u, sets = S.Clusters(caps), [{i} for i in range(20)]
        for _ in range(40):
            a, b = r.randrange(20), r.randrange(20)
            x, y = (next(s for s in sets if i in s) for i in (a, b))
            free = x is y or not {caps[i] for i in x} & {caps[i] for i in y}
            assert u.join(a, b) == free
            if free and x is not y:
                sets.remove(y)
                x |= y
        assert sorted(sorted(m) for m in u.members if m) == sorted(map(sorted, sets))


# Fixed inputs: clusters of (capture, frame) whose order is known.
GAP = [[(0, 0), (1, 0)], [(1, 1)], [(0, 1), (1, 2)], [(0, 2), (1, 3)]]
CHAINS = [[(0, 0)], [(0, 1), (1, 0)], [(1, 1)], [(1, 2)], [(0, 2), (1, 3)], [(0, 3)]]
CYCLE = [[(0, 0)], [(0, 1), (1, 1)], [(0, 2), (1, 0)], [(0, 3)], [(0, 4)]]
FALSE_MATCH = [[(0, 0), (0, 2)], [(0, 1)]]


def test_orders(spark):
    cases = [GAP, CHAINS, CYCLE, FALSE_MATCH]
    reads = spark.createDataFrame([(w, k, c, f) for w, clusters in enumerate(cases) for k, own in enumerate(clusters) for c, f in own], "window long, cluster long, cap long, f long")
    order = {}
    for x in sorted(S.ordered(spark, reads).collect(), key=lambda x: x["rank"]):
        order.setdefault(x.window, []).append(x.cluster)
    place = {(x.window, x.cluster): x.place for x in S.positions(spark, reads).collect()}
    assert order[0] == [0, 1, 2, 3]
    assert place[1, 1] < place[1, 2] < place[1, 3] < place[1, 4]
    assert order[1] == [0, 1, 2, 3, 4, 5]
    assert sorted(order[2]) == [0, 1, 2, 3, 4] and order[2][0] == 0 and order[2].index(3) < order[2].index(4)
    assert sorted(order[3]) == [0, 1]


def test_orders_follow_chains_and_places():
    """Of all orders that follow the chains the first in places; with contradictions each node once, and what is not in a knot in order."""
    r = random.Random(8)
    for _ in range(200):
        n = r.randint(1, 6)
        place = {k: r.choice([0.0, 1.0, 2.0, 2.5]) for k in range(n)}
        chains = [r.sample(range(n), r.randint(0, n)) for _ in range(r.randint(0, 2))]
        got = S.ranked(chains, place)
        fits = [p for p in itertools.permutations(range(n)) if all(p.index(a) < p.index(b) for c in chains for a, b in zip(c, c[1:]))]
        assert sorted(got) == list(range(n))
        if fits:
            assert tuple(got) == min(fits, key=lambda p: [(place[k], k) for k in p])


def path_cost(cost, path, lam, mu):
    total = sum(row[v] for row, v in zip(cost, path))
    return total + sum(mu if a == b else lam * (b - a - 1) for a, b in zip(path, path[1:]))


def test_viterbi_is_the_cheapest_path():
    r = random.Random(1)
    for _ in range(40):
        cost = [[r.random() for v in range(5)] for _ in range(5)]
        got = S.cheapest_path(np.zeros(5, np.int64), np.array(cost), lam=0.05, mu=0.1).tolist()
        best = min(path_cost(cost, p, 0.05, 0.1) for p in itertools.product(range(5), repeat=5) if all(a <= b for a, b in zip(p, p[1:])))
        assert all(a <= b for a, b in zip(got, got[1:]))
        assert path_cost(cost, got, 0.05, 0.1) == pytest.approx(best)


def test_heaviest_rise():
    r = random.Random(2)
    for k in range(60):
        v, w = [r.randrange(6) for _ in range(8)], [r.random() if k % 2 else r.choice([1.0, 2.0]) for _ in range(8)]
        got = S.heaviest_rise(v, w)
        best = max(sum(w[i] for i in c) for k in range(1, 9) for c in itertools.combinations(range(8), k) if all(v[a] <= v[b] for a, b in zip(c, c[1:])))
        assert all(v[a] <= v[b] for a, b in zip(got, got[1:])) and sum(w[i] for i in got) == pytest.approx(best)
    assert S.heaviest_rise([], []) == []


def test_alignment_through_a_static_run(spark):
    """A known map through nearly equal signatures, with steps, is found again."""
    from tapeframe.operators import align

    rng = np.random.default_rng(11)
    ref = rng.normal(size=(120, 40))
    ref[50:70] = ref[50] + rng.normal(size=(20, 40)) * 0.05
    steps = [1] * 80
    steps[20], steps[45] = 4, 4
    path = np.cumsum([10, *steps])
    path = path[path < 118]
    rows = [(0, i, (ref[i]).tolist()) for i in range(120)]
    query = [(0, f, (ref[v] * 0.95 + 4).tolist()) for f, v in enumerate(path)]
    schema = "seq long, f long, sig array<double>"
    corr = align.banded(spark.createDataFrame(rows, schema), spark.createDataFrame(query, schema), stride=1.0, band=25)
    got = S.viterbi_align(align.winsorized_cost(corr)).toPandas().sort_values("f")
    assert got["v"].tolist() == path.tolist()


def test_hysteresis():
    assert S.keep_canvas([{0: 5, 1: 9}, {0: 12, 1: 4}, {0: 30, 1: 4}, {1: 3}, {0: 1, 1: 9}]) == [0, 0, 1, 1, 1]


def test_greedy_pairs():
    assert S.greedy([(0, 3), (1, 2), (1, 4), (2, 4)], True) == [(0, 3), (1, 4)]
    assert S.greedy([(0, 3), (1, 2), (1, 4), (2, 4)], False) == [(0, 3), (1, 2), (2, 4)]
    assert S.track([[5], [6, 9], [2, 8], [], [700]]) == [5, 6, 8, -1, 700]


def test_segments_fit():
    assert S.fit_segment([[5, 5], [5, 5, 5]], 100) == ([[5, 5], [5, 5, 5]], 0)
    assert S.fit_segment([[5, 5], [5, 5, 5]], 12) == ([[5], [5]], 3)
    assert S.fit_segment([[5, 5], [5, 5, 5]], 12, {1}) == ([[], [5, 5]], 3)
    assert S.fit_segment([[5]], -1) == ([[]], -1)


def test_segments_fit_without_python_groups(spark):
    r = random.Random(5)
    rows = [(s, b, k, r.choice([0, 1, 5, 30, 50])) for s in range(60) for b in range(1, r.randint(1, 6)) for k in sorted(r.sample(range(20), r.randint(1, 7)))]
    words = spark.createDataFrame(r.sample(rows, len(rows)), "segment long, block long, k long, bits long")
    for capacity in (-1, 0, 60, 120, 10_000):
        want = {}
        for s in {x[0] for x in rows}:
            own = [x for x in rows if x[0] == s]
            left, dropped = S.fit_segment([[x[3] for x in own if x[1] == b] for b in sorted({x[1] for x in own})], capacity)
            want[s] = (sum(map(len, left)), dropped, sum(map(sum, left)))
        found = S.fitted_segments(words, capacity)
        assert {x.segment: (x.words, x.dropped, x.bits) for x in found.collect()} == want
        assert "Pandas" not in found._jdf.queryExecution().toString()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, S.plain_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges for x in e}


def test_constrained_components(spark):
    edges = spark.createDataFrame([(0, "A", 2, "B", 9), (1, "A", 2, "B", 5), (0, "A", 4, "C", 4), (10, "A", 11, "B", 1)], "a long, cap_a string, b long, cap_b string, votes long")
    got = {r.node: r.cluster for r in S.constrained_components(edges, S.plain_components(spark, edges.select("a", "b"))).collect()}
    assert got == {0: 0, 2: 0, 4: 0, 1: 1, 10: 10, 11: 10}
    assert {r.node: r.refused for r in S.constrained_components(edges, S.plain_components(spark, edges.select("a", "b"))).collect()}[0] == 1


def test_empty(spark):
    empty = spark.createDataFrame([], "window long, pos long, read long, n_bad long")
    assert S.canvas_hysteresis(empty).count() == 0
