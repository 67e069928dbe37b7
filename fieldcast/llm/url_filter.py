"""URL filters: a cascade of Bloom filters answers membership in the rule list exactly for the corpus's keys, without joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import ascii_lower, fresh, stored, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Bits for each listed key in the first level and in the later ones, and probes of a key.
FIRST_BITS, LATER_BITS, PROBES = 16, 8, 4


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), ascii_lower(rest)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), rest).otherwise("")


def keys_of(host: str, path: str, depths: tuple[int, ...]) -> Iterator[tuple[int, str]]:
    """(length, key): the host and its parent domains, longest first, with each path prefix of a length that some rule has.

    A rule of host h and path p fits just those urls among whose keys h + p is.
    """
    while True:
        for d in depths:
            if len(path) >= d:
                yield len(host) + d, host + path[:d]
        cut = host.find(".")
        if cut < 0:
            return
        host = host[cut + 1 :]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate({i: i + 32 for i in range(65, 91)}), slash + path


class Level:
    """One Bloom filter. Its size follows from the number of keys that it encodes."""

    def __init__(self, keys: list[str], bits_a_key: int, seed: int):
        self.seed, self.bits = seed, max(64, len(keys) * bits_a_key)
        self.field = np.zeros((self.bits + 7) // 8, np.uint8)
        for key in keys:
            for at in self.places(key):
                self.field[at >> 3] |= 1 << (at & 7)

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h & (2**64 - 1), h >> 64 | 1
        return [(a + i * b) % self.bits for i in range(PROBES)]

    def __contains__(self, key: str) -> bool:
        return all(self.field[at >> 3] >> (at & 7) & 1 for at in self.places(key))


class Cascade:
    """Levels in turn encode listed keys and the others that the level before mistook for such.

    The first level that does not contain a key tells: a miss at level 0, 2, ... means unlisted, at 1, 3, ... listed.
    """

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _mistaken(keys: DataFrame, cascade: Cascade, listed: frozenset[str]) -> DataFrame:
    """The keys outside the list that the cascade so far takes for listed."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[k in cascade and k not in listed for k in f["key"]]]

    return keys.mapInPandas(task, "key string")


def build(listed: list[str], universe: DataFrame) -> Cascade:
    """A cascade that is exact for every key of universe(key) and for every listed key.

    Level 0 has 16 bits and 4 probes a listed key, so that about 0.24 % of the other keys pass; later levels halve
    what is left several times over. What reaches the driver is the mistaken keys only, and after level 0 these are
    as few as the false positives; should they be more than `listed` itself, level 0 is built anew with twice the
    bits, so that the filters stay in proportion to the rule list and never to the corpus.
    """
    listed = sorted(set(listed))
    inside, bits = frozenset(listed), FIRST_BITS
    while True:
        cascade = Cascade()
        cascade.levels.append(Level(listed, bits, 0))
        wrong = stored(_mistaken(universe, cascade, inside), "cascade")
        if wrong.count() <= max(1024, len(listed)):
            break
        bits *= 2
    others, mine = [r.key for r in wrong.toLocalIterator()], listed
    while others:
        cascade.levels.append(Level(others, LATER_BITS, len(cascade.levels)))
        mine = [k for k in mine if k in cascade.levels[-1]]  # listed keys that the level takes for unlisted
        if not mine:
            break
        cascade.levels.append(Level(mine, LATER_BITS, len(cascade.levels)))
        others = [k for k in others if k in cascade.levels[-1]]
    return cascade


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules is a list of (verdict, rule), a rule being host/path-prefix; it is the operator's parameter and bounds
    the filters. A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    fitting rule wins, the longer host at equal length, and the first given at equal text. Where none fits the
    verdict is `default` and rule is null. Null urls and urls without :// have host and path '' and fit no rule.
    Repeated rows are judged each; an empty table gives no rows; columns named host, path, rule or verdict are
    replaced, others stay.
    """
    verdicts: dict[str, tuple[str, str]] = {}
    for verdict, rule in rules:
        host, path = split_rule(rule)
        verdicts.setdefault(host + path, (rule, verdict))
    depths = tuple(sorted({len(split_rule(rule)[1]) for _, rule in rules}, reverse=True))
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})

    def universe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": list({k for h, p in zip(f["host"], f["path"], strict=True) for _, k in keys_of(h, p, depths)})}, dtype=object)

    heads = split.select("host", F.substring("path", 1, max(depths, default=0)).alias("path")).distinct()
    keys = stored(heads.mapInPandas(universe, "key string").distinct(), "url-keys")
    names = sorted(verdicts)
    cascade = build(names, keys)

    @F.pandas_udf("string")
    def found(host: pd.Series, path: pd.Series) -> pd.Series:
        memo: dict[str, bool] = {}

        def one(h: str, p: str) -> str | None:
            for _, k in sorted(keys_of(h, p, depths), key=lambda x: -x[0]):
                if memo.setdefault(k, k in cascade) if k not in memo else memo[k]:
                    return k
            return None

        return pd.Series([one(h, p) for h, p in zip(host, path, strict=True)], dtype=object)

    (key,) = fresh(split.columns, "listed_key")
    of = lambda i: F.create_map(*[F.lit(x) for k in names for x in (k, verdicts[k][i])]) if names else F.create_map().cast("map<string,string>")
    out = split.withColumn(key, found("host", "path"))
    return out.withColumns({"rule": F.try_element_at(of(0), F.col(key)), "verdict": F.coalesce(F.try_element_at(of(1), F.col(key)), F.lit(default))}).drop(key)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
OP7_SQL = rf"""
WITH s AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
r AS (
  SELECT *, CASE WHEN {_FITS.format("example.net", "/en/")} THEN 'example.net/en/'
                 WHEN {_FITS.format("example.com", "/de/")} THEN 'example.com/de/'
                 WHEN {_FITS.format("org", "/fr/")} THEN 'org/fr/'
                 WHEN {_FITS.format("net", "/")} THEN 'net/' END AS rule
  FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
