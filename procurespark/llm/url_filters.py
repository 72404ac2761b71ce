"""URL filters by a sort-merge range join.

With its labels reversed, a host stands in the interval of each rule for it or a domain
above it. URLs and rules are dealt out by ranges of these keys and sorted; one sweep
over each range keeps the rules that are open, nested in one another, on a stack. A rule
is sent to each range that its interval meets, so no range needs another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import ascii_lower
from procurespark.llm.shared import ranges as runs_of

#: Keys drawn for each range when their bounds are chosen; all that the driver holds.
DRAWN = 40
LAST = chr(0x10FFFF)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels from the last to the first, a dot after each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The open rules while rows pass in the order of their keys."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, dict[str, str], list[int]]] = []

    def reach(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        """Opens a rule. Of rules equal but for the verdict, block holds."""
        self.reach(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, host, {}, []))
        _, _, paths, sizes = self.open[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest open rule whose path begins ``path`` (of equals that of the longer host), and its verdict."""
        self.reach(key)
        best, said, size = None, None, -1
        for _, host, paths, sizes in self.open:
            for n in sizes:
                if n <= len(path) and (verdict := paths.get(path[:n])) is not None:
                    if len(host) + n >= size:
                        best, said, size = host + path[:n], verdict, len(host) + n
                    break
        return best, said


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages``.

    ``rules`` has host, path and verdict (allow or block), in any number. A rule fits its
    host and all subdomains if the URL's path starts with its own; the longest (host and
    path together) wins; without one the verdict is ``default`` and the rule null. A null
    URL or one without "://" has an empty host and path; rules with a null or empty host
    fit nothing, a null path is empty; null ids stay null; repeated rows come back each;
    other columns are not read; an empty table gives an empty result. Equal keys are
    spread over all ranges whose bound they are, so a frequent URL fills no single range.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The order within a host is that of paths, so one host may take many ranges. The rows of the
    # lowest hashes are a sample of a fixed size, drawn in one pass and the same each time.
    full = urls.select(F.concat("key", F.lit("\x00"), "path").alias("k"), F.xxhash64("page_id", "key", "path").alias("draw"))
    drawn = sorted(r.k for r in full.orderBy("draw", "k").limit(DRAWN * n).collect())
    bounds = np.array([drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else [], object)

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _strings(pa.compute.binary_join_element_wise(batch.column("key"), batch.column("path"), "\x00"))
            lo, hi = np.searchsorted(bounds, keys), np.searchsorted(bounds, keys, side="right")
            to = lo + batch.column("spread").to_numpy() % (hi - lo + 1)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(batch.column(c) for c in URL)], ["range", *URL])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _strings(batch.column("key"))
            lo, hi = np.searchsorted(bounds, keys), np.searchsorted(bounds, keys + LAST if len(keys) else keys, side="right")
            at = np.repeat(np.arange(len(batch)), hi - lo + 1)
            to = runs_of(lo, hi - lo + 1)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(batch.column(c).take(pa.array(at)) for c in URL)], ["range", *URL])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = Sweep(), None
        for batch in batches:
            if not len(batch):
                continue
            range_, kind = batch.column("range").to_numpy(), batch.column("kind").to_numpy()
            keys, paths = _strings(batch.column("key")), _strings(batch.column("path"))
            # Equal URLs follow one another and are looked up once.
            new = np.ones(len(batch), bool)
            new[1:] = (range_[1:] != range_[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0) | (keys[1:] != keys[:-1]) | (paths[1:] != paths[:-1])
            rules, said = [], []
            for k in np.flatnonzero(new).tolist():
                if range_[k] != at:
                    state, at = Sweep(), range_[k]
                if kind[k]:
                    rule, verdict = state.find(keys[k], paths[k])
                else:
                    rule = verdict = None
                    state.add(keys[k], batch.column("host")[k].as_py(), paths[k], batch.column("verdict")[k].as_py())
                rules.append(rule)
                said.append(verdict or default)
            own = np.flatnonzero(kind)
            each = pa.array((np.cumsum(new) - 1)[own])
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("page_id", "host", "path")), pa.array(rules, pa.string()).take(each), pa.array(said, pa.string()).take(each)], ["page_id", "host", "path", "rule", "verdict"])

    ruled = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")).filter(F.length("host") > 0)
    ruled = ruled.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    listed = urls.select("key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 30)).alias("spread"))
    kinds = "range int, key string, kind int, page_id long, host string, path string, verdict string"
    dealt = ruled.mapInArrow(deal_rules, kinds).union(listed.mapInArrow(deal_urls, kinds))
    placed = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "key", "kind", "path")
    return placed.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


#: Columns of URLs and rules alike on their way to a range.
URL = ["key", "kind", "page_id", "host", "path", "verdict"]


def _strings(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(object)

#: Fixed rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: DuckDB SQL of the registered query.
URL_FILTER_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
    SELECT s.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
        row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS k
    FROM split s JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fitting WHERE k = 1) f ON s.page_id = f.page_id
"""
