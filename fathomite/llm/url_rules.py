"""URL filters. Built-in functions only.

Two tables judge a URL. Host rules name a host and a path: the longest that fits a URL's host, or one it is a subdomain
of, and the start of its path, wins. Where none fits, pattern rules decide: ``^`` stands for an edge or any character
that is no letter or digit, ``*`` for anything. A pattern's literal tokens are its runs of letters and digits with such
an edge on both sides; every URL that it matches has them all. The pattern is indexed by that one of them which is
rarest in the URLs at hand; a URL's tokens fetch their patterns from the index, and only those run as regular
expressions. Patterns without a whole token are tried on every URL.

The index is a constant of ``BUCKETS`` maps by CRC-32 of the key, so a lookup scans few entries even with many rules.
A table of rules is a parameter of at most ``MOST_RULES`` rows, checked before it becomes part of the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 256
MOST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGE = "(?:^|$|[^a-z0-9])"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        return "(?s)" + "".join({"^": EDGE, "*": ".*"}.get(c, re.escape(c) if not c.isalnum() else c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        return re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", "*" + self.pattern + "*")


HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)
PATTERN_RULES = tuple(
    PatternRule("block", p)
    for p in (
        "^casino^", "^poker^", "^betting^", "^cheap^pills^", "^pills^", "^viagra^", "^porn^", "^xxx^", "^adult^", "^escort^",
        "^warez^", "^torrent^", "^keygen^", "^crack^download^", "^free^*^download^*.exe^", "^payday^loan^", "^replica^watches^", "*doubleclick*",
    )
) + (PatternRule("allow", "^casino^museum^"),)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and the path up to ``?``, ``#`` or the end. Both empty without ``://`` and for null."""
    safe = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(safe, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(safe, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the URL, A-Z lower-cased."""
    flat = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.array_remove(F.split(flat, "[^a-z0-9]+"), ""))


def _index(entries: list[tuple[str, dict]], fields: str) -> Column:
    """A constant array of maps, key to its entries in the order given."""
    if len(entries) > MOST_RULES:
        raise ValueError(f"{len(entries)} rules; a table has {MOST_RULES} at most")
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, entry in entries:
        maps[zlib.crc32(key.encode()) % BUCKETS].setdefault(key, []).append(entry)
    return F.from_json(F.lit(json.dumps(maps)), f"array<map<string,array<struct<{fields}>>>>")


def _fetch(index: Column, keys: Column) -> Column:
    """The entries of all ``keys``, in one array."""
    found = F.transform(keys, lambda k: F.try_element_at(F.element_at(index, (F.crc32(k) % BUCKETS + 1).cast("int")), k))
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def rarest_tokens(urls: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """How many rows of ``urls`` have each token of the rules; only those tokens are counted and returned."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    hits = urls.select(F.explode(F.array_intersect(tokens_of(F.col(url_col)), F.array(*map(F.lit, wanted)))).alias("token"))
    counted = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: counted.get(t, 0) for t in wanted}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row of ``pages``.

    rule is the host rule that decided, pattern the pattern rule; both null where the default, allow, holds. A pattern
    that allows overrides those that block; among equals the first in the table is named. Null and odd URLs have an
    empty host and path and fit no host rule. Ids may be null or repeat; other columns are ignored; no shuffle but for
    the token counts.
    """
    counts = rarest_tokens(pages, url_col, pattern_rules)
    entries, everywhere = [], []
    for at, r in enumerate(pattern_rules):
        entry = {"at": at, "pattern": r.pattern, "regex": r.regex, "verdict": r.verdict}
        if r.tokens:
            entries.append((min(r.tokens, key=lambda t: (counts[t], t)), entry))
        else:
            everywhere.append(entry)
    fields = "at:int,pattern:string,regex:string,verdict:string"
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.translate(F.coalesce(url_col, F.lit("")), UPPER, LOWER).alias("_url"), tokens_of(F.col(url_col)).alias("_tokens"), host.alias("host"), path.alias("path"))

    ends = F.split("host", r"\.")
    over = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.array_join(F.slice(ends, i, F.size(ends)), "."))
    own = _index([(r.host, {"n": len(r.text), "rule": r.text, "path": r.path, "verdict": r.verdict}) for r in host_rules], "n:int,rule:string,path:string,verdict:string")
    fits = F.filter(_fetch(own, over), lambda r: F.col("path").startswith(r["path"]))
    rows = rows.withColumn("_host_rule", F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))))

    tried = F.concat(_fetch(_index(entries, fields), F.col("_tokens")), F.from_json(F.lit(json.dumps(everywhere)), f"array<struct<{fields}>>"))
    rows = rows.withColumn("_tried", F.when(F.col("_host_rule").isNull(), tried)).withColumn("_hits", F.filter("_tried", lambda r: F.rlike(F.col("_url"), r["regex"])))
    first = F.array_min(F.transform("_hits", lambda r: F.struct((r["verdict"] != "allow").alias("blocks"), r["at"].alias("at"), r["pattern"].alias("pattern"), r["verdict"].alias("verdict"))))
    rows = rows.withColumn("_pattern", first)
    return rows.select(id_col, "host", "path", F.col("_host_rule.rule").alias("rule"), F.coalesce("_host_rule.verdict", "_pattern.verdict", F.lit("allow")).alias("verdict"), F.col("_pattern.pattern").alias("pattern"))


def oracle_sql(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """DuckDB SQL over the table pages: every rule is tried on every URL, without an index."""
    fit = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in host_rules)
    tried = ", ".join(f"({i}, '{r.verdict}', '{r.pattern}', '{r.regex}')" for i, r in enumerate(pattern_rules))
    return f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h(v, hh, pp) AS (VALUES {fit}), t(i, v, pattern, re) AS (VALUES {tried}),
own AS (SELECT rid, arg_max(hh || pp, length(hh || pp)) AS rule, arg_max(v, length(hh || pp)) AS v FROM p JOIN h ON (host = hh OR ends_with(host, '.' || hh)) AND starts_with(path, pp) GROUP BY rid),
pat AS (SELECT rid, arg_min(pattern, (v <> 'allow')::INT * 100000 + i) AS pattern, arg_min(v, (v <> 'allow')::INT * 100000 + i) AS v FROM p JOIN t ON regexp_matches(u, re) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(own.v, pat.v, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN own USING (rid) LEFT JOIN pat USING (rid)
"""
