import hashlib
import random
from collections import Counter

import pytest

from tapeframe.llm import lines as L
from tapeframe.llm import sharding as H


def brute_lines(rows, ratio):
    pages = {(s, t) for _, t, s, _ in rows if t is not None}
    total = Counter(s for s, _ in pages)
    n = Counter((s, x) for s, t in pages for x in set(t.split("\n")) if x.strip(" \t\r\f\v"))
    drop = {k for k, v in n.items() if v > 1 and v > ratio * total[k[0]]}
    out = []
    for i, t, s, z in rows:
        ls = [] if t is None else t.split("\n")
        kept = [x for x in ls if (s, x) not in drop]
        out.append((i, None if t is None else "\n".join(kept), s, z, len(ls), len(ls) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(5)
    rows = [(i, "\n".join(["menu"] * (i % 3 > 0) + [f"own {i}", "", " \t", f"shared {i % 40}"] + ["é footer"] * (i % 2)), r.choice(["a", "a", "b", None]), i % 5) for i in range(200)]
    rows += [(300, None, "a", None), (301, "", "b", 1), (302, "menu\nmenu", "tiny", 1), (303, "menu\nmenu", "tiny", 1), (None, "menu\nx", "a", 2), (5, rows[5][1], rows[5][2], 0)]
    return rows + [(400 + i, "copied line\nof one text", "b", 0) for i in range(150)] + [(600, "x " * 50000 + "\nmenu", "a", 0)]


SCHEMA = "doc_id long, text string, source string, n_lines int"


@pytest.mark.parametrize("ratio", [0.05, 0.6])
def test_lines_against_brute_force(spark, ratio):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines int").selectExpr("*", "1 as n_lines", "2 as host", "3 as n_dropped", "4 as __host", "5 as __kept", "6 as kept", "map(1, 2) as `a.b`")
    got = L.without_boilerplate(docs, ratio)
    assert got.columns == ["doc_id", "text", "source", "lines", "host", "__host", "__kept", "kept", "a.b", "n_lines", "n_dropped"]
    assert {tuple(r) for r in got.select("host", "__host", "__kept", "kept").collect()} == {(2, 4, 5, 6)}
    assert sorted(map(tuple, got.drop("host", "__host", "__kept", "kept", "`a.b`", "a.b").collect()), key=repr) == brute_lines(rows, ratio)


def test_copies_of_a_page_keep_their_text(spark):
    got = {r.doc_id: r for r in L.without_boilerplate(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert got[400].text == "copied line\nof one text" and got[600].n_dropped == 1


def test_no_lines(spark):
    assert L.without_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def maglev(shards, slots):
    number = lambda s, a: int(hashlib.md5(s.encode()).hexdigest()[a : a + 8], 16)
    table, nxt = [None] * slots, [0] * len(shards)
    for turn in range(slots):
        i = turn % len(shards)
        while True:
            slot = (number(shards[i], 0) % slots + nxt[i] * (number(shards[i], 8) % (slots - 1) + 1)) % slots
            nxt[i] += 1
            if table[slot] is None:
                table[slot] = shards[i]
                break
    return table


@pytest.mark.parametrize(("shards", "slots"), [(H.SHARDS, H.SLOTS), (("a",), 2), (("a", "b", "c"), 7)])
def test_table_is_filled_in_turns(spark, shards, slots):
    got = {r.slot: r.shard for r in H.lookup_table(spark, shards, slots).collect()}
    assert [got[i] for i in range(slots)] == maglev(shards, slots)
    sizes = Counter(got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_placement(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (-5, "")], "doc_id long, shard string").selectExpr("*", "1 as slot")
    table = maglev(H.SHARDS, H.SLOTS)
    want = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % H.SLOTS
    got = Counter(map(tuple, H.place(rows, H.lookup_table(spark)).collect()))
    assert got == Counter((i, want(t), table[want(t)]) for i, t in ((1, "1"), (1, "1"), (None, ""), (-5, "-5")))
    assert H.place(rows.limit(0), H.lookup_table(spark)).count() == 0


def test_few_slots_move_when_a_shard_goes():
    a, b = maglev(H.SHARDS, H.SLOTS), maglev(H.SHARDS[:-1], H.SLOTS)
    moved = sum(x != y and x != H.SHARDS[-1] for x, y in zip(a, b))
    assert moved < 0.1 * H.SLOTS


def test_bad_tables_are_refused(spark):
    for shards, slots in ((("a",), 4), ((), 7), (("a", "a"), 7)):
        with pytest.raises(ValueError):
            H.lookup_table(spark, shards, slots)


def test_no_python_on_the_main_path(spark):
    plan = H.place(spark.range(3).withColumnRenamed("id", "doc_id"), H.lookup_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


