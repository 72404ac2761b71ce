"""Ranked search and the prefix trie against brute force and SQL, on odd rows too."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_corpus_operators import LONG, ODD, empty, lowered, odd  # noqa: F401

from procurespark.llm import lexical_search, prefix_trie


def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))


def ranked(docs, items, k=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        found = []
        for (i, c), n in zip(held, sizes):
            m = 100 - 75 + (75 * n * total) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        yield from ((item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1))


def test_search_of_odd_rows(spark, odd, monkeypatch):
    docs = [(i, t) for i, t, *_ in ODD]
    items = [(1, "Two, words of a LINE"), (2, "no ID at all répétée 日本語のテキスト"), (3, None), (4, "!?"), (5, "absent everywhere"), (None, "shared own line twenty twenty"), (1, "secret token"), (7, LONG)]
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = Counter(ranked(docs, items))
    for block in (1, 1_000_000):
        assert Counter(map(tuple, lexical_search.search(odd, asked, block_chars=block).collect())) == want
    monkeypatch.setattr(lexical_search, "BATCH_DOCS", 3)
    monkeypatch.setattr(lexical_search, "STEP", 1)
    assert Counter(map(tuple, lexical_search.search(odd.coalesce(1), asked).collect())) == want
    assert lexical_search.search(empty(odd), asked).count() == 0 and lexical_search.search(odd, empty(asked)).count() == 0


def test_masks_leave_most_documents_alone():
    """The bound ends the evaluation early and changes nothing."""
    rng = np.random.default_rng(2)
    terms = pa.array([f"t{k}" for k in range(80)], pa.large_binary())
    rows = [np.sort(rng.choice(80, rng.integers(1, 40), replace=False)) for _ in range(3000)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term, impact = np.concatenate(rows), rng.integers(1, 50, at[-1])
    block = lexical_search.Block([(0, 0)], [(np.arange(75), rng.integers(1, 3, 75))], terms, rng.integers(0, 40, 80))
    looked = []

    class Seen(lexical_search._Best):
        def add(self, score, ids):
            looked.append(len(ids))
            super().add(score, ids)

    best = [Seen(10)]
    for x in range(0, 3000, 500):
        part = slice(at[x], at[x + 500])
        lexical_search.search_batch(block, best, np.arange(x, x + 500), at[x : x + 501] - at[x], term[part], impact[part])
    weight = np.zeros(80, np.int64)
    weight[:75] = block.weight[:75] * block.held[0][1]
    score = np.add.reduceat(weight[term] * impact, at[:-1])
    order = np.lexsort((np.arange(3000), -score))[:10]
    assert best[0].id.tolist() == order.tolist() and best[0].score.tolist() == score[order].tolist()
    assert sum(looked) < 2000


@given(st.lists(st.lists(st.booleans(), min_size=70, max_size=70), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_distinct_masks(columns):
    present = np.array(columns, bool).T
    first, code = lexical_search.distinct_masks(present)
    assert len(first) == len(set(map(tuple, columns)))
    assert (present[:, first[code]] == present).all()


def trie_of(rows):
    """All eight columns of each node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(role, text) for _, _, role, _, text in sorted(held)] for c, held in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, held in built.items():
        for d in range(len(held) + 1):
            nodes[held[:d]].append(c)
    below = Counter(key[:-1] for key in nodes if key)
    saved, leaves = Counter(), Counter()
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1].encode()) if key else 0
            leaves[key[:d]] += not below[key]
    return Counter(
        (min(m), len(key), min(nodes[key[:-1]]) if key else None, len(m), below[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == key))).encode()).hexdigest())
        for key, m in nodes.items()
    )


def columns_of(df):
    return Counter(map(tuple, df.select(*prefix_trie.NODES).collect()))


@pytest.mark.parametrize("width", [1, 16, 1 << 12])
def test_trie_of_odd_rows(spark, width, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 4)
    rng = np.random.default_rng(width)
    roles, texts = ["user", "assistant", None, ""], ["a", "b", "é", None, "", "日本"]
    rows = [(int(c), int(t), roles[rng.integers(4)], texts[rng.integers(6)]) for c in range(-12, 60) for t in range(rng.integers(0, 9))]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(c % 4 + 1)]  # many conversations that are alike
    rows += [(200, t, "user", f"turn {t}") for t in range(40)] + [(201, t, "user", f"turn {t}") for t in range(30)]
    rows += [(None, 1, "user", "of no conversation"), (300, None, "user", "z"), (300, 0, "user", "y"), (300, 1, "b", "x"), (300, 1, "a", "x"), (301, 2, None, LONG), (301, 2, None, LONG), rows[3]]
    df = spark.createDataFrame([(*r, "mine", 5) for r in rows], "conv_id long, turn long, role string, text string, depth string, at int").repartition(5)
    got = prefix_trie.conversation_trie(df, width)
    assert columns_of(got) == trie_of(rows)
    proved = got.filter("proved").count()
    assert (proved > 50) == (width > 16) and got.filter("proved AND n_convs > 1").count() == 0
    assert prefix_trie.conversation_trie(empty(df), width).count() == 0


def test_trie_of_conversations_without_turns_left(spark):
    """Conversations that are no more than what isn't there."""
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:6]
    rows = [(c, 0, "user", "x") for c in ids]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert columns_of(got) == trie_of(rows) and got.select("depth").first().depth == 0 and got.count() == 1


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_search"])
def test_sql_agrees(spark, name):
    from procurespark.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = QUERIES[name](spark, sf)
    theirs = con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, mine.collect())) == Counter(map(tuple, theirs)) and theirs


def test_texts_of_conversations_are_not_shuffled_after_their_turns_are_numbered(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert set(prefix_trie.rebuilt(df).columns) == {"conv", "at", "d1", "d2", "size"}
    assert prefix_trie.prefixes(prefix_trie.rebuilt(df)).filter(F.col("ends")).count() == 1
