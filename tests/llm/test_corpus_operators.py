"""Each operator against a brute-force version on rows with every kind of oddity."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procurespark.llm import decontaminate, encoding, licenses, line_dedup, packing, quality, secrets, simhash, token_counts, token_records, url_filters
from procurespark.llm.checksums import crc32c
from procurespark.llm.shared import flat_text
from procurespark.storage import new_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "Une longue phrase, répétée encore; " * 20_000
HEX = "0123456789abcdef" * 2
#: id, text, source, and columns whose names operators use themselves
ODD = [
    (1, None, None, "x", 1), (2, "", "a", None, None), (3, "   \n\n ", "a", "y", 2), (4, "one", "b", "y", 2), (5, "Two words", "b", "y", 2), (5, "Two words", "b", "y", 2),
    (6, LONG, "c", "y", 3), (7, LONG, None, "z", 3), (None, "no id at all", "c", "z", 3), (8, "tok<|endoftext|>en  x\tB\r\n\x1c!", "c", "z", 3),
    (9, f"secret = '{HEX}' and AKIAABCDEFGHIJKL12 é token: abc", "d", "z", 3), (10, f"token={HEX} Released under the MIT License.", "e", "z", 3),
    (11, "A shared line of twenty characters\nown line eleven", "d", "z", 3), (12, "  a SHARED line of twenty characters\nown line twelve", "d", "z", 3),
    (13, "a shared line of twenty characters\na shared line of twenty characters\nx", "e", "z", 3), (14, "日本語のテキスト 本 語 です 𝒳𝒴", "e", "z", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, n_tokens string, _rank int").repartition(3)


def empty(df):
    return df.limit(0)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_token_counts(odd):
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in ODD)
    assert Counter(map(tuple, token_counts.token_counts(odd, VOCABULARY).collect())) == want
    assert token_counts.token_counts(empty(odd), VOCABULARY).count() == 0


@given(st.lists(st.text(alphabet=" \n\t.,;!'<|>aZé\u0085\u00a0\x1c日#9", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_library_s_ids(texts):
    made = encoding.encoder(VOCABULARY)
    ids, offsets = made.ids(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == [made.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert made.counts(pa.array(texts, pa.string())).tolist() == np.diff(offsets).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_windows_and_cache_do_not_show(name, monkeypatch):
    made = encoding.Encoder(public_tokenizers.path(name))
    texts = ["Some words, again and again. " * 300, "x", "", "Others, again; " * 200 + "end"]
    want = [len(x) for x in made._plain(texts)]
    monkeypatch.setattr(encoding, "WINDOW_BYTES", 1 << 10)
    monkeypatch.setattr(encoding, "CACHED_PIECES", 8)
    monkeypatch.setattr(encoding, "PLAIN_BYTES", 500)
    assert made.counts(pa.array(texts)).tolist() == want


def test_token_records_round_trip(spark, odd):
    library = Tokenizer.from_file(VOCABULARY)
    path = new_path(spark, "records")
    token_records.write_token_records(odd, path, VOCABULARY, end_id=2)
    rows = token_records.read_token_records(spark, path, with_ids=True).orderBy("start").collect()
    start, want = 0, []
    for i, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, start, len(ids), zlib.crc32(raw), raw))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rows] == want
    shuffled = token_records.read_token_records_shuffled(spark, path, seed=5).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in shuffled) == Counter((w[0], w[4]) for w in want)
    none = new_path(spark, "records")
    token_records.write_token_records(empty(odd), none, VOCABULARY, end_id=2)
    assert token_records.read_token_records(spark, none).count() == 0


def test_a_changed_byte_is_found():
    framed, _ = token_records._frames([7], np.array([5, 6, 7], "<u2"), np.array([0, 3]))
    assert token_records._checked(framed)[0][1].tolist() == [5, 6, 7]
    spoilt = bytearray(framed[0])
    spoilt[-6] ^= 1
    with pytest.raises(ValueError):
        token_records._checked([bytes(spoilt)])


@given(st.lists(st.binary(min_size=4, max_size=700), min_size=1, max_size=5))
@settings(max_examples=50, deadline=None)
def test_crc32c(parts):
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert plain(b"123456789") == 0xE3069283
    offsets = np.cumsum([0, *map(len, parts)])
    assert crc32c(np.frombuffer(b"".join(parts), np.uint8), offsets).tolist() == [plain(p) for p in parts]


def test_every_stretch_of_a_long_item_and_items_of_few_characters():
    rng = np.random.default_rng(12)
    letters = list("etaoin shrdlu")
    made = lambda n: "x" + "".join(rng.choice(letters, n - 2)) + "y"
    item = made(600)
    index = decontaminate.build([(0, item)], decontaminate.PARTS)
    for size in (99, 200):
        texts = [f"{made(40)} {item[at : at + size]} {made(40)}" for at in range(0, 600 - size + 1, 1 if size == 200 else 7)]
        assert {t for t, *_ in decontaminate.search(index, texts)} == set(range(len(texts)))
    few = [(n, made(n)) for n in range(5, 41)]
    index = decontaminate.build(few, decontaminate.PARTS)
    texts = [f"{made(30)} {text}. {made(30)}" for _, text in few] + [made(200)]
    found = {(t, item) for t, item, *_ in decontaminate.search(index, texts)}
    single = lambda t: re.sub(" +", " ", t)
    held = lambda t, text: re.search(rf"(?<!\w){re.escape(single(text))}(?!\w)", single(t)) is not None
    assert found == {(k, n) for k, t in enumerate(texts) for n, text in few if held(t, text)}


def test_packing(spark, odd):
    library = Tokenizer.from_file(VOCABULARY)
    packed = packing.pack_tokens(odd, VOCABULARY, end_id=2, capacity=64, with_ids=True)
    rows = packed.collect()
    want = Counter()
    for i, t, *_ in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        lead = len(ids) % 64 or 64
        cuts = [0, *range(lead, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = struct.pack(f"<{b - a}I", *ids[a:b])
            want[i, k, a, b - a, zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) + 1
    assert packing.packed_sequences(packed).agg(F.sum("n_tokens"), F.sum(F.length("ids"))).first() == (total, 4 * total)
    assert packing.pack_tokens(empty(odd), VOCABULARY).count() == 0


@given(st.lists(st.integers(1, 32), max_size=60))
@settings(max_examples=150, deadline=None)
def test_packing_plan_uses_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=33)
    plan = packing.packing_plan(counts, 32)
    used = Counter()
    for combination, times in plan:
        assert 0 < sum(combination) <= 32 and times > 0
        for n in combination:
            used[n] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in plan) <= len(lengths)


def lines_of(rows):
    docs, keep = defaultdict(set), {}
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(i)
    for k, ids in docs.items():
        if len(ids) >= 3:
            keep[k] = max(ids, key=lambda i: (i is not None, i or 0))
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keep.get(key(x), i) == i]
        out[i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()] += 1
    return out


def test_line_dedup(odd):
    assert Counter(map(tuple, line_dedup.line_dedup_digest(odd).collect())) == lines_of(ODD)
    kept = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("old")))
    assert set(kept.columns) == {*odd.columns, "n_lines", "n_dropped"}
    assert kept.filter("doc_id = 13").first().text == "a shared line of twenty characters\na shared line of twenty characters\nx"
    assert line_dedup.line_dedup_digest(empty(odd)).count() == 0


def spans_of(text):
    kinds = [(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32)]
    found = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= n)
    return [sum(s[1] == k for s in found) for k in range(3)], ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def test_secrets(spark, odd):
    want = Counter()
    for i, t, *_ in ODD:
        counts, base = spans_of(t)
        want[(i, *counts, hashlib.sha256(base.encode()).hexdigest())] += 1
    rows = secrets.secret_digest(odd).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    said = {r.doc_id: r for r in rows}
    assert (said[9].n_live, said[9].n_example) == (1, 2)  # the key is the source's own; another source has the other values
    assert secrets.secret_digest(empty(odd)).count() == 0
    live = spark.createDataFrame([(1, "Authorization: Bearer abcdefghijklmnop1234", "a"), (2, "bearer commonexample0123456789", "a"), (3, "bearer commonexample0123456789", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.spans for r in secrets.secret_digest(live).collect()} == {1: "bearer:15:42", 2: "", 3: ""}


@given(st.text(alphabet="tokensecrapi_AKI=:\"' 0f9é\n", max_size=80))
@settings(max_examples=12, deadline=None)
def test_secret_spans(spark, text):
    row = secrets.scan_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).select("base").first()
    assert row.base == spans_of(text)[1]


def test_copies_and_long_values_of_one_owner_stay_live(spark):
    copied, password = "Bearer abcdefghijklmnop1234", "p" * 300
    url, pem = f"https://{'u' * 100}:{password}@host", f"-----BEGIN {'VERY ' * 10}PRIVATE KEY-----"
    rows = [(i, copied, "a", i) for i in range(9)] + [(10, url, "b", 1), (11, pem, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repository long")
    want = {i: f"bearer:0:{len(copied)}" for i in range(9)} | {10: f"url:0:{len(url) - 4}", 11: f"pem:0:{len(pem)}"}
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert {i: r.spans for i, r in got.items()} == want and all((r.n_live, r.n_example) == (1, 0) for r in got.values())
    by_repository = {r.doc_id: r.spans for r in secrets.scan_secrets(docs, repository_col="repository").collect()}
    assert by_repository == want | dict.fromkeys(range(9), "")


def counts_of(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark, odd):
    rows = quality.quality_digest(odd).collect()
    want = Counter()
    for i, t, *_ in ODD:
        n = counts_of(t)
        want[(i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality_digest(empty(odd)).count() == 0
    good = " ".join(f"word{i}" for i in range(80))
    hosts = spark.createDataFrame([(i, good if i % 10 == 0 and i < 100 or i >= 100 else "bad", "farm" if i < 100 else f"h{i % 5}") for i in range(400)], "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.quality_digest(hosts).filter("kept").collect()}
    assert kept == set(range(100, 400))  # the farm's good documents go with it
    assert {r.doc_id for r in quality.keep_good(hosts).collect()} == kept
    assert quality.keep_good(odd).columns == odd.columns


@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=60), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_quality_counts(texts):
    data, offsets = flat_text(pa.array(texts, pa.string()))
    made = quality._features(data, offsets)
    assert [tuple(int(made[k][i]) for k in quality.FEATURES[:5]) for i in range(len(texts))] == [counts_of(t) for t in texts]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("a.net", "", "allow"), (None, "/", "block"), ("", "/", "block"), ("x.net", None, "block")]


def verdict_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lowered(re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fit = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://Example.com/en/1?x", "https://m.example.com/en/2#t", "http://www.example.com/en/", "http://b.www.example.com/en/x", "ftp://c.com", "http://com/", "http://x.net/es/1", "http://a.net/fr", "http://b.a.net/es/", "http://xa.net/es/", "http://a://b.com/", "http://ex.com/é日"]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "http://x.net/", "h", "p")] + [(100 + i, "http://www.example.com/en/", "h", "p") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for ranges in (1, 7):
        got = url_filters.filter_urls(pages, rules, ranges=ranges).collect()
        assert Counter(map(tuple, got)) == Counter((i, *verdict_of(u)) for i, u, *_ in rows)
    one = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://one.example.com/"), F.col("id").cast("string")).alias("url"))
    spread = url_filters.filter_urls(one, rules, ranges=8).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 800  # one host takes many ranges
    assert url_filters.filter_urls(empty(pages), rules).count() == 0
    assert url_filters.filter_urls(pages, empty(rules)).filter("verdict <> 'allow' or rule is not null").count() == 0


def fingerprint_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(nodes))]


def test_simhash(odd):
    prints = [fingerprint_of(t) for _, t, *_ in ODD]
    roots = components_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {r: min((ODD[k][0] for k in range(len(ODD)) if roots[k] == r and ODD[k][0] is not None), default=None) for r in set(roots)}
    want = Counter((row[0], f"{fp:016x}", lowest[r]) for row, fp, r in zip(ODD, prints, roots))
    assert Counter(map(tuple, simhash.simhash_components(odd).collect())) == want
    assert simhash.simhash_components(empty(odd)).count() == 0


def test_labels_stay_connected_whatever_links_are_added():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(2, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(1, 60))))
        label = np.arange(n)
        for part in np.array_split(np.arange(len(a)), 3):
            label = simhash._joined(n, a[part], b[part], label)
        pairs = {(int(x), int(y)) for x, y in zip(a, b)}
        assert label.tolist() == components_of(range(n), lambda x, y: (x, y) in pairs or (y, x) in pairs)


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    found = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    for _ in range(260):
        x = centre if rng.random() < 0.6 else int(rng.choice(list(found)))
        for b in rng.choice(62, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        found.add(x)
    fps = sorted(found)
    roots = components_of(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    sizes = Counter(roots)
    assert got == {f: fps[r] for f, r in zip(fps, roots) if sizes[r] > 1}


@pytest.mark.parametrize(("compared", "tabulated"), [(24, 1024), (3, 1024), (3, 8)])
def test_crowded_variants(monkeypatch, compared, tabulated):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    monkeypatch.setattr(simhash, "TABULATED", tabulated)
    rng = np.random.default_rng(4)
    base = np.uint64(rng.integers(0, 1 << 63))
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(200)], np.uint64))
    keys = simhash._variants(fps)
    order = np.argsort(keys.ravel().view(np.int64), kind="stable")
    a, b = simhash._meet(keys.ravel()[order], np.repeat(fps, keys.shape[1])[order])
    at = {int(f): i for i, f in enumerate(fps)}
    joined = {(at[int(x)], at[int(y)]) for x, y in zip(a, b)}
    nodes = list(range(len(fps)))
    assert components_of(nodes, lambda i, j: (i, j) in joined or (j, i) in joined) == components_of(nodes, lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 3)


@pytest.mark.parametrize("coinciding", [False, True])
def test_links_of_crowded_fingerprints(spark, coinciding):
    rng = np.random.default_rng(6)
    key = 0x1234_5678_0002_0001  # as a key it may be of the first mask or of the second
    found = {key & ~0xFFFF | int(x) for x in rng.choice(1 << 16, 1300, replace=False)}
    if coinciding:
        found |= {key & ~0xFFFF0000 | int(x) << 16 for x in rng.choice(1 << 16, 1300, replace=False)}
    fps = sorted(found)
    assert len(fps) > simhash.TABULATED
    values = np.array(fps, np.uint64)
    a, b = (x.tolist() for x in np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3))
    roots = list(range(len(fps)))
    while True:
        new = np.array(roots)
        np.minimum.at(new, a, np.array(roots)[b])
        if new.tolist() == roots:
            break
        roots = new.tolist()
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    sizes = Counter(roots)
    assert got == {f: fps[r] for f, r in zip(fps, roots) if sizes[r] > 1}


def test_near_dedup_stage(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = [None, "", "one", "One ", "two words"]
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 500, rng.integers(20, 90))]
        for _ in range(5):
            other = list(words)
            for at in rng.integers(0, len(words), rng.integers(0, 5)):
                other[at] = f"W{rng.integers(0, 500)}"
            texts.append(" ".join(other))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", "en", "s", 12), rows[9]]

    def shingles(text):
        words = lowered(text).split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    held = [shingles(t) for _, t, *_ in rows]
    roots = components_of(held, lambda a, b: 10 * len(a & b) >= 8 * len(a | b))
    want = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in set(roots)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want.values())
    assert len(want) > len(texts) // 6 and corpus_pipeline.near_dedup(spark, empty(docs), "").count() == 0


def test_licenses(spark, odd):
    mit = re.sub("<[^>]*>", "", licenses.TEMPLATES[1][1])
    more = [(20, f"The MIT License\n\nCopyright (c) 2024 Someone Else\n\n{mit}"), (21, mit.replace("hereby", "thereby")), (22, "CC-BY-NC, cc by nc! xcc by nc"), (23, "Licensed under the Apache License, Version 2.0."), (24, "Distributed under the GNU General Public License, version 3")]
    rows = [(i, t) for i, t, *_ in ODD] + more
    got = defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
        places = [(k, label) for phrase, label in licenses.BASE_PHRASES for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted({label for _, label in places}))
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert [got[k][0].labels for k in (20, 21, 22, 23, 24)] == ["mit", "", "cc-by-nc", "apache-2", "gpl-3"]
    assert got[20][0].score == 1.0
    assert licenses.scan_licenses(empty(odd)).count() == 0


def wording(rng, template):
    """A text that the template accepts, and a regular expression for all of them."""
    stack, pattern = [[]], ""
    for part in re.findall(r"<[^>]*>|[^<\s]+", template):
        if part == "<opt>":
            stack.append([])
            pattern += "(?:"
        elif part == "</opt>":
            words = stack.pop()
            stack[-1] += words if rng.random() < 0.5 else []
            pattern += ")?"
        elif m := re.fullmatch(r"<var:(\d+)>", part):
            stack[-1] += ["any"] * int(rng.integers(0, int(m[1]) + 1))
            pattern += rf"(?:\S+ ){{0,{m[1]}}}"
        else:
            choices = part[5:-1].split("|") if part.startswith("<var:") else [part]
            stack[-1].append(str(rng.choice(choices)))
            pattern += f"(?:{'|'.join(choices)}) "
    return stack[0], re.compile(f"(?:^| ){pattern}")


def test_license_templates(spark):
    rng = np.random.default_rng(3)
    texts, patterns = [], []
    for label, template in licenses.TEMPLATES:
        for k in range(4):
            words, pattern = wording(rng, template)
            if k > 1:  # a word too many or too few
                at = int(rng.integers(len(words)))
                words[at : at + 1] = [] if k == 2 else [words[at], "other"]
            texts.append(f"Some words before, {', '.join(words).upper()} - and after.")
        patterns.append((label, pattern))
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        words = " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(texts[r.doc_id]))) + " "
        want = {label for label, p in patterns if p.search(words)} | {label for phrase, label in licenses.BASE_PHRASES if f" {phrase} " in f" {words}"}
        assert set(filter(None, r.labels.split(","))) == want, texts[r.doc_id]
    few = licenses.scan_licenses(spark.createDataFrame([(1, "under the house license, one")], "doc_id long, text string"), [("house", "under the house <var:license|licence>")])
    assert [(r.labels, r.score) for r in few.collect()] == [("house", 0.8)]


def edits(pattern, text):
    """Fewest edits of the pattern anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_decontamination(spark, odd):
    item = "Which of the following reagents is used to precipitate plasmid DNA after alkaline lysis of bacteria?"
    other = "A train leaves the station at noon and travels sixty miles an hour for two and a half hours before it stops."
    changed = item.replace("reagents", "reagent").replace("plasmid", "Plasmid  ").replace("lysis", "lisys")
    docs = spark.createDataFrame(
        [(1, f"x {item}"), (2, f"{LONG}{changed} {LONG}"), (3, item[: len(item) // 2]), (4, LONG), (5, None), (6, ""), (None, other), (7, f"{other}{item}"), (8, other.upper())],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "too short"), (None, item)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(rows) == {(1, 1), (2, 1), (None, 2), (7, 1), (7, 2), (8, 2)}
    assert (rows[1, 1].start, rows[1, 1].stop, rows[1, 1].edits) == (2, 2 + len(item), 0)
    assert rows[2, 1].edits == 3 and abs(rows[2, 1].start - len(LONG)) <= 3
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_chars=1).collect()} == set(rows)
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.find_leaks(odd, empty(bench)).count() == 0 and decontaminate.find_leaks(empty(docs), bench).count() == 0


def test_decontamination_ignores_case_of_any_letter():
    item = "Éai éonleeau pour an éonqueê, öffne die Tür: ЖУК и мышь"
    index = decontaminate.build([(3, item)], decontaminate.Rules())
    assert decontaminate.search(index, ["x", f"({item.upper()})", f"\U0001f600 {item.lower()}"]) == [(1, 3, 1, 1 + len(item), 0), (2, 3, 2, 2 + len(item), 0)]


def test_decontamination_loses_nothing_within_the_bound():
    rng = np.random.default_rng(5)
    letters = list("etaoin shrdlu")
    rules = decontaminate.Rules()
    items = [(k, "".join(rng.choice(letters, rng.integers(40, 190)))) for k in range(25)]
    index = decontaminate.build(items, rules)
    for k, text in items:
        held = list(text.strip())
        for _ in range(rng.integers(0, 2 + rules.edits(len(held)))):
            at = int(rng.integers(len(held)))
            held[at : at + int(rng.integers(0, 2))] = [str(rng.choice(letters))][: int(rng.integers(0, 2))]
        doc = "".join(rng.choice(letters, 50)) + "".join(held) + "".join(rng.choice(letters, 50))
        plain = "".join(map(chr, decontaminate.normalized(text.strip())[0]))
        near = edits(plain, "".join(map(chr, decontaminate.normalized(doc)[0]))) <= rules.edits(len(plain))
        assert (k in {item for _, item, *_ in decontaminate.search(index, [doc])}) == near


def test_decontamination_of_parts_short_items_and_items_without_an_id(spark):
    rng = np.random.default_rng(9)
    letters = list("etaoin shrdlu")
    made = lambda n: "x" + "".join(rng.choice(letters, n - 2)) + "x"
    items = {k: made(n) for k, n in enumerate((400, 400, 150, 60, 40))}
    held = [items[0][50:250], items[1][137:237], items[2][7:142], items[3][4:58], items[4][2:38]]
    docs = [(k, f"{made(60)} {part} {made(60)}") for k, part in enumerate(held)]
    docs += [(10, "It was Mid-May 1812, then."), (11, "the mid-may 18123"), (12, made(70)), (13, f"-{made(50)} only named here, without an id at all -")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (7, "mid-May  1812"), (8, ""), (None, "only named here, without an id at all")], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(rows) == {*((k, k) for k in items), (10, 7)}
    assert (rows[10, 7].start, rows[10, 7].stop, rows[10, 7].edits) == (7, 19, 0)
    assert all(rows[k, k].edits == 0 and rows[k, k].start >= 61 for k in (0, 1))
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {11, 12}
    only = decontaminate.find_leaks(docs, bench.filter("item_id = 7")).collect()
    assert [(r.doc_id, r.item_id) for r in only] == [(10, 7)]


@pytest.mark.parametrize("name", ["op3_secrets", "op4_line_dedup", "op5_quality", "op7_url_filter"])
def test_sql_agrees(spark, name):
    from procurespark.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine = QUERIES[name](spark, sf)
    theirs = con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, mine.collect())) == Counter(map(tuple, theirs))


def test_secrets_of_a_text_of_very_many_matches(spark):
    """Time follows the number of matches, not its square."""
    value = "0123456789abcdef" * 2
    text = " é ".join([value] * 50_000 + ["token: short", "token=longenough1"])
    row = secrets.scan_secrets(spark.createDataFrame([(1, text, "a"), (2, "secret: no", "a")], "doc_id long, text string, source string")).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_hex, r.n_live) for r in row] == [(1, 50_000, 50_001), (0, 0, 0)]
    spans = row[0].base.split(",")
    assert spans[:2] == ["hex:0:32", "hex:35:67"] and spans[-1] == f"assign:{len(text) - 17}:{len(text)}" and len(spans) == 50_001
