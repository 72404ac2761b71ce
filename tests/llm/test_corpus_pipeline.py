"""The pipeline's stages and the whole of it against brute force, and rows with columns of awkward names."""

import math
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_corpus_operators import LONG, VOCABULARY, components_of, counts_of, empty, fingerprint_of, lowered
from tokenizers import Tokenizer

import corpus_pipeline
from procurespark.llm import decontaminate, encoding, licenses, line_dedup, near_copies, quality

GOOD = " ".join(f"word{i}" for i in range(80))
#: Columns that operators might use themselves, beside those of documents.
NAMES = "doc_id long, text string, lang string, source string, n_chars long, _hash string, _host string, _f_n_words long, _q_host string, _k_id string, fp long, n_lines long, id string, row long, node long, _text string"


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", "  ", GOOD, GOOD, GOOD.upper(), "short", LONG, f"{GOOD} more", "a line of more than twenty letters\nx", "a line of more than twenty letters\ny", "a line of more than twenty letters"]
    rows = [(i if i != 6 else None, t, "en", None if i % 4 == 0 else "s", None, f"h{i}", "mine", i, "q", "k", i, -i, "i", i, i, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], NAMES).repartition(3)


def held_by(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("keep", [quality.keep_good, near_copies.keep_one_similar])
def test_rows_come_back_as_they_are(awkward, keep):
    kept = keep(awkward)
    assert kept.dtypes == awkward.dtypes
    got = held_by(kept)
    assert got <= held_by(awkward) and sum(got.values()) > 1
    assert keep(empty(awkward)).count() == 0
    ids = {r[0] for r in got}
    assert ids - {8} == ({3, 4, 5} if keep is quality.keep_good else {0, 3, None, 7, 9, 10, 11})  # 8 is a near copy of 3, as each measures it


def test_line_dedup_and_decontamination_leave_other_columns_alone(spark, awkward):
    rest = [c for c in awkward.columns if c not in ("text", "n_chars")]
    deduped = line_dedup.dedup_lines(awkward, counts=False)
    assert deduped.dtypes == awkward.dtypes and held_by(deduped.select(rest)) == held_by(awkward.select(rest))
    staged = corpus_pipeline.line_dedup(spark, awkward, "")
    assert staged.dtypes == awkward.dtypes and all(r.n_chars == len(r.text) for r in staged.collect())
    bench = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8")], "item_id long, text string")
    clean = decontaminate.without_leaks(awkward, bench)
    assert held_by(clean) == Counter({r: n for r, n in held_by(awkward).items() if "word3 word4" not in (r[1] or "").lower()})


def test_host_verdicts_by_hand(spark):
    rng = np.random.default_rng(4)
    share = {"a": 0.9, "b": 0.05, "c": 0.1, "d": 0.0, None: 0.04, "e": 1.0}
    rows, n = [], 0
    for host, bad in share.items():
        for k in range(3 if host == "e" else 120):
            rows.append((n := n + 1, "bad" if k < bad * 120 else GOOD + f" {rng.integers(1 << 30)}", host))
    got = quality.quality_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    counts = defaultdict(lambda: [0, 0])
    for _, text, host in rows:
        counts[host][0] += 1
        counts[host][1] += text == "bad"
    total, bad = sum(n for n, _ in counts.values()), sum(k for _, k in counts.values())
    m = bad / total
    spread = sum(n * (k / n - m) ** 2 for n, k in counts.values())
    between = (spread - (len(counts) - 1) * m * (1 - m)) / (total - sum(n * n for n, _ in counts.values()) / total - (len(counts) - 1))
    v = min(max(1, m * (1 - m) / between - 1), 1e6) if between > 0 else 1e6
    rate = {h: (k + m * v) / (n + v) for h, (n, k) in counts.items()}
    bar = max(0.2, min(3 * m, (m + 1) / 2))
    failed = {h: rate[h] - 3 * math.sqrt(rate[h] * (1 - rate[h]) / (counts[h][0] + v + 1)) > bar for h in rate}
    assert [h for h in failed if failed[h]] == ["a"]  # three documents of e say too little
    of = {i: (text, host) for i, text, host in rows}
    for r in got:
        text, host = of[r.doc_id]
        assert (r.host_failed, r.host_rate) == (failed[host], pytest.approx(rate[host], abs=2e-6))
        assert r.kept == (text != "bad" and not failed[host])


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", lowered(text))


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def shingles_of(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize(("held_texts", "held"), [(3, 400), (1 << 14, 1 << 20)])
def test_near_copies_in_groups_beyond_a_task(spark, held_texts, held):
    """Chains of copies of copies, so that most links don't end at a component's first text."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(6):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        for _ in range(14):
            texts.append(" ".join(words))
            words[int(rng.integers(len(words)))] = f"n{rng.integers(300)}"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    roots = components_of([shingles_of(t) for t in texts], alike)
    got = {r.doc_id for r in near_copies.keep_one_similar(docs, held_texts=held_texts, held=held).collect()}
    assert got == set(roots)


def test_near_dedup_by_fingerprints_and_by_sets(spark):
    """Copies that only fingerprints tell, copies that only sets tell, and one of each in a row."""
    rng = np.random.default_rng(8)

    def edited(text, n):
        words = text.split()
        for at in rng.choice(len(words), n, replace=False):
            words[at] = f"n{rng.integers(9000)}"
        return " ".join(words)

    apart = lambda a, b: (fingerprint_of(a) ^ fingerprint_of(b)).bit_count()
    base = " ".join(f"w{x}" for x in rng.integers(0, 9000, 220))
    one = next(t for t in (edited(base, 5) for _ in range(500)) if apart(t, base) <= 3 and not alike(shingles_of(t), shingles_of(base)))
    two = next(t for t in (edited(one, 4) for _ in range(500)) if apart(t, one) > 3 and apart(t, base) > 3 and alike(shingles_of(t), shingles_of(one)) and not alike(shingles_of(t), shingles_of(base)))
    other = " ".join(f"w{x}" for x in rng.integers(0, 9000, 220))
    rows = [(30, two), (9, base), (20, one), (40, one.upper()), (2, other), (5, edited(other, 60)), (7, None), (6, " "), (50, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    held = [(shingles_of(t), fingerprint_of(t or "")) for _, t in rows]
    roots = components_of(held, lambda a, b: alike(a[0], b[0]) or (a[1] ^ b[1]).bit_count() <= 3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(min(rows[k][0] for k in range(len(rows)) if roots[k] == root) for root in set(roots)) == [2, 5, 6, 9]
    assert corpus_pipeline.near_dedup(spark, empty(docs), "").count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_whole_pipeline(spark, tmp_path):
    rng = np.random.default_rng(30)
    item = "Which of the following reagents is used to precipitate plasmid DNA after alkaline lysis of bacteria?"
    rows, n = [], 0
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 900, rng.integers(40, 160))]
        for c in range(int(rng.integers(1, 4))):
            other = list(words)
            for at in rng.integers(0, len(words), c):
                other[at] = f"n{rng.integers(900)}"
            text = " ".join(other) + ("\nThis footer stands below very many pages" if k % 3 == 0 else "") + (f" {item} " if k % 9 == 4 else "")
            rows.append((n := n + 1, text, "en", f"s{k % 4}", len(text)))
    rows += [(n + 1, None, "en", None, None), (n + 2, "", "en", "s1", 0), (n + 3, LONG, "fr", "s1", len(LONG)), (None, " ".join(f"z{i}" for i in range(70)), "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t, *_ in rows if counts_of(t)[0] >= 50 and 2 * counts_of(t)[4] <= counts_of(t)[0]]  # no source fails
    common = defaultdict(set)
    for i, t in left:
        for line in t.split("\n"):
            common[lowered(line.strip())].add(-1 if i is None else i)
    keep = {line: max(ids) for line, ids in common.items() if len(ids) >= 3 and len(line) >= 20}
    left = [(i, "\n".join(x for x in t.split("\n") if keep.get(lowered(x.strip()), i) == i)) for i, t in left]
    roots = components_of([shingles_of(t) for _, t in left], alike)
    best = {}
    for root, (i, t) in zip(roots, left):
        best[root] = min(best.get(root, (i is None, i, t)), (i is None, i, t))
    left = [(i, t) for _, i, t in best.values() if item.lower() not in t.lower()]
    library, want = Tokenizer.from_file(VOCABULARY), Counter()
    for i, t in left:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 30 < len(left) < len(rows) - 30
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_by_hand(spark):
    """The queries that no SQL expresses, over a whole small table."""
    from procurespark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = Tokenizer.from_file(VOCABULARY)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    read = lambda name, *columns: {r[0]: tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()}

    assert read("op8_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == {i: (i, len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in rows.items()}
    want, start = {}, 0
    for i in sorted(rows):
        own = np.array([*ids[i], 2], "<u4")
        want[i] = (i, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert read("op2_token_records", "doc_id", "start", "n_tokens", "ids_crc32") == want
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in QUERIES["op6_packing"](spark, sf).collect())
    cut = Counter()
    for i in rows:
        own = np.array([*ids[i], 2], "<u4")
        ends = [0, *range(len(own) % 1024 or 1024, len(own) + 1, 1024)]
        cut.update((i, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:])))
    assert pieces == cut

    order = sorted(rows)
    prints = [fingerprint_of(rows[i]) for i in order]
    roots = components_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert read("op9_simhash", "doc_id", "fingerprint", "component_id") == {i: (i, f"{p:016x}", order[r]) for i, p, r in zip(order, prints, roots)}

    for i, (_, n_words, n_base, first, last, labels) in read("op10_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").items():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(rows[i]))
        places = [(k, label) for phrase, label in licenses.BASE_PHRASES for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        assert (n_words, n_base, first, last, labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))

    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    plain = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t.lower()).strip()
    texts = {i: plain(t) for i, t in rows.items()}
    verbatim = {(i, k) for k, item in items.items() for i, t in texts.items() if plain(item) in t}
    assert verbatim <= found
    words = {i: set(t.split()) for i, t in texts.items()}
    assert all(len(words[i] & set(plain(items[k]).split())) * 2 > len(set(plain(items[k]).split())) for i, k in found)  # what is found shares most of its words


def test_packing_leaves_no_encoder_in_workers(spark, tmp_path, monkeypatch):
    own = shutil.copy(VOCABULARY, tmp_path / "own.json")
    docs = spark.createDataFrame([(i, f"{GOOD} {i} {LONG}") for i in range(40)], "doc_id long, text string").repartition(8)
    want = held_by(corpus_pipeline.packing(spark, docs, ""))
    monkeypatch.setattr(corpus_pipeline, "VOCABULARY", str(own))
    assert held_by(corpus_pipeline.packing(spark, docs, "")) == want

    def kept(batches):
        from procurespark.llm import encoding

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(own) in encoding._encoders] * len(batch))], ["kept"])

    assert spark.range(0, 64, 1, 64).mapInArrow(kept, "kept boolean").filter("kept").count() == 0


def test_an_encoder_with_few_places_gives_the_same_ids():
    texts = pa.array([f"{GOOD} {i} some words of text {i}, and more" for i in range(200)])
    few = encoding.Encoder(VOCABULARY, 50)
    many = encoding.Encoder(VOCABULARY)
    for k in range(0, 200, 20):
        for a, b in zip(few.ids(texts.slice(k, 20)), many.ids(texts.slice(k, 20)), strict=True):
            assert a.tolist() == b.tolist()
    assert len(few.known) < len(many.known)
