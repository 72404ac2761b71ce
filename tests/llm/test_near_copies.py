"""b-bit MinHash near copies against brute force."""

import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import ODD, components_of, empty, lowered, odd  # noqa: F401

from procurespark.llm import near_copies


def shingles_of(text, size=4):
    words = lowered(text).split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def expected(rows, size=4):
    held = [shingles_of(t, size) for _, t in rows]
    roots = components_of(held, lambda a, b: len(a) > 0 and 100 * len(a & b) >= 80 * len(a | b))
    least = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in set(roots)}
    return Counter((i, len(h), least[r], i == least[r]) for (i, _), h, r in zip(rows, held, roots))


def test_odd_rows(spark, odd):  # noqa: F811
    rows = [(i, t) for i, t, *_ in ODD]
    assert Counter(map(tuple, near_copies.near_components(odd).collect())) == expected(rows)
    assert near_copies.near_components(empty(odd)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, " ")], "doc_id long, text string")
    assert Counter(map(tuple, near_copies.near_components(blank).collect())) == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 2, (None, 0, None, True): 1})


@pytest.mark.parametrize(("held_texts", "held"), [(2, 300), (1 << 14, 1 << 20)])
def test_chains_of_copies(spark, held_texts, held):
    """Copies of copies, short and long, whose links mostly don't end at a group's first; cut into tasks or not."""
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(14):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 90))]
        for _ in range(12):
            rows.append((len(rows) * 7 % 997, " ".join(words)))
            words[int(rng.integers(len(words)))] = f"N{rng.integers(400)}"
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(rows)
    assert Counter(map(tuple, near_copies.near_components(docs, held_texts=held_texts, held=held).collect())) == want
    assert 20 < sum(kept for *_, kept in want) < 150


def random_group(rng, n, words, values, edits):
    base, sets = rng.integers(0, 1 << 62, words).astype(np.uint64), []
    for _ in range(n):
        own = base.copy()
        for at in rng.integers(0, words, edits):
            own[at : at + 4] = rng.integers(0, values, len(own[at : at + 4])).astype(np.uint64)
        sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    keys, packed = near_copies._signed(np.concatenate(sets), sizes)
    return sets, np.concatenate(sets), sizes, packed, keys


@pytest.mark.parametrize("two", [False, True])
def test_groups_by_leaders_and_index(two):
    rng = np.random.default_rng(5 + two)
    for _ in range(25):
        sets, flat, sizes, packed, keys = random_group(rng, 120, int(rng.integers(8, 60)), int(rng.choice([5, 50, 1 << 50])), int(rng.integers(1, 4)))
        side = rng.integers(0, 2, len(sets)) if two else np.zeros(len(sets), int)
        held = [(set(s.tolist()), k, p, d) for s, k, p, d in zip(sets, keys, packed, side)]

        def links(a, b):
            common = len(a[0] & b[0])
            near = 10 * common >= 8 * (len(a[0]) + len(b[0]) - common) and (a[1] == b[1]).any() and near_copies.equal_minima(a[2], b[2][None])[0] >= near_copies.CLOSE
            return near and not (two and a[3] == b[3])

        roots = components_of(held, links)
        got = near_copies.similar(flat, sizes, np.arange(len(sets)), side, packed, keys.view(np.int64))
        assert len(set(zip(roots, got.tolist()))) == len(set(roots)) == len(set(got.tolist()))


def test_close_pairs_of_a_band():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = int(rng.integers(3, 40))
        packed = rng.integers(0, 1 << 62, (4, 5)).astype(np.uint64)[rng.integers(0, 4, n)]
        for k in range(n):
            for bit in rng.integers(0, 64, rng.integers(0, 12)):
                packed[k] ^= np.uint64(1) << np.uint64(bit)
        head = packed[0]
        is_open = near_copies.equal_minima(head, packed) < near_copies.CLOSE
        got = near_copies.close_groups(packed, is_open, np.zeros(n, int))
        items = list(range(n))
        roots = components_of(items, lambda a, b: not is_open[a] and not is_open[b] or near_copies.equal_minima(packed[a], packed[b][None])[0] >= near_copies.CLOSE)
        assert len(set(zip(roots, got.tolist()))) == len(set(roots)) == len(set(got.tolist()))


def test_bits_estimate_similarity(spark):
    rng = np.random.default_rng(7)
    for similarity in (0.2, 0.5, 0.8, 1.0):
        both = rng.integers(0, 1 << 62, int(2000 * similarity / (1 + similarity) * 2)).astype(np.uint64)
        own = [np.unique(np.concatenate([both, rng.integers(0, 1 << 62, 2000 - len(both)).astype(np.uint64)])) for _ in range(2)]
        _, packed = near_copies._signed(np.concatenate(own), np.array([len(x) for x in own]))
        equal = near_copies.equal_minima(packed[0], packed[1:])[0]
        exact = len(np.intersect1d(*own)) / len(np.union1d(*own))
        assert abs(near_copies.estimate(equal) - exact) < 0.2
        row = spark.createDataFrame([tuple(map(lambda p: tuple(p.view(np.int64).tolist()), packed))], "a struct<{0}>, b struct<{0}>".format(near_copies.LONGS.replace(" long", ":long")))
        assert row.select(near_copies._equal("a", "b").alias("n")).first().n == equal


def test_many_short_copies_take_seconds():
    """Each copy has an edit of its own, which leaves most pairs a little under the bar."""
    _, flat, sizes, packed, keys = random_group(np.random.default_rng(1), 30_000, 30, 1 << 60, 1)
    began = time.time()
    near_copies.similar(flat, sizes, np.arange(len(sizes)), np.zeros(len(sizes), int), packed, keys.view(np.int64))
    assert time.time() - began < 30


def test_tasks_are_bounded_and_meet_each_open_one_with_all(spark):
    rows = [(g, n, n % 4 == 0 and g > 0, 1) for g, size in ((0, 5), (1, 40), (2, 9)) for n in range(size)]
    members = spark.createDataFrame([(g, n + 100 * g, o, w) for g, n, o, w in rows], "group int, node long, open boolean, weight int")
    tasks = defaultdict(list)
    for r in near_copies._dealt(members, 10).collect():
        tasks[r.group, r.x, r.y].append((r.node, r.side))
    met = Counter()
    for (g, x, y), held in tasks.items():
        sides = {d for _, d in held}
        met.update({(g, *sorted((a, b))) for a, d in held for b, e in held if a < b and (len(sides) < 2 or d != e)})
    for g, n, is_open, _ in rows:
        if is_open:
            chunkmates = {(g, *sorted((n + 100 * g, m + 100 * g))) for h, m, _, _ in rows if h == g and m != n}
            assert chunkmates <= set(met)
    assert max(map(len, tasks.values())) <= 24


def test_sql_agrees(spark):
    from procurespark.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine = QUERIES["op12_minhash"](spark, sf)
    theirs = con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL['op12_minhash']})").fetchall()
    assert Counter(map(tuple, mine.collect())) == Counter(map(tuple, theirs)) and theirs


def test_components_of_a_star_and_a_chain(spark):
    from procurespark.llm.simhash import components

    star = [(k, 5000) for k in range(3000)] + [(7000 + k, 7001 + k) for k in range(40)] + [(9000, 9000)]
    links = spark.createDataFrame(star, "a long, b long").repartition(5)
    want = Counter({(k, 0): 1 for k in (*range(3000), 5000)}) + Counter({(7000 + k, 7000): 1 for k in range(41)})
    assert Counter(map(tuple, components(links).collect())) == want
    assert components(links.limit(0)).count() == 0
    assert components(links.filter(F.col("a") == 9000)).count() == 0
