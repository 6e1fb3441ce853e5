"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over the URL in the form `host` + `path`. Its
literal tokens, runs of [a-z0-9] that any match must contain whole, are counted
over the corpus, and the rule is filed under the rarest of them. A rule of several
alternatives is filed under the rarest token of each alternative. A URL looks up
its own tokens, and only the rules found that way run their expression.

List rules name a host and a path prefix; they fit that host and its subdomains.
The longest fitting list rule decides. Where none fits, the URL is blocked if a
pattern rule of the policy matches, else allowed.

Edge cases: null urls and urls without `://` have an empty host and path, fit no
rule and are allowed; repeated rows are judged one by one; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._spark import table

_TOKEN = re.compile(r"[a-z0-9]+")
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A rule: its name, its verdict, its expression over lower-cased host + path, the literals of each alternative, its rank."""

    name: str
    verdict: str
    pattern: str
    alternatives: tuple[tuple[str, ...], ...]
    rank: int = 0


def list_rule(verdict: str, text: str) -> Rule:
    """`host/path`: that host and its subdomains, paths that start with the path (case matters there)."""
    host, _, path = text.partition("/")
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", "/" + path)
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", ((*_TOKEN.findall(host), *whole),), len(text))


def pattern_rule(name: str, pattern: str, *alternatives: tuple[str, ...]) -> Rule:
    """A block rule of the policy; every match contains all literals of one of the `alternatives` as whole tokens."""
    return Rule(name, "block", pattern, alternatives)


LIST_RULES = (
    list_rule("allow", "org/"),
    list_rule("block", "example.org/es/"),
    list_rule("block", "example.org/en/1"),
    list_rule("allow", "com/fr/"),
    list_rule("block", "com/de/"),
)

#: Labels of hosts, segments of paths and endings of files that the policy blocks.
HOST_LABELS = (
    "ads", "adserver", "adservice", "doubleclick", "tracking", "tracker", "analytics", "metrics", "pixel", "beacon", "banner", "popunder", "affiliate", "clicks",
    "xxx", "porn", "casino", "poker", "betting", "warez", "torrent", "proxy",
)
PATH_SEGMENTS = (
    "login", "signin", "signup", "register", "logout", "cart", "checkout", "basket", "wishlist", "account", "wp-admin", "wp-login", "cgi-bin",
    "unsubscribe", "captcha", "sitemap", "feed", "rss", "trackback", "search-results",
)
FILE_ENDINGS = ("exe", "msi", "dmg", "apk", "iso", "zip", "rar", "gz", "jpg", "png", "gif", "mp3", "mp4", "avi", "css", "js")

POLICY = (
    *(pattern_rule(f"host-{w}", rf"^(?:[^/]*\.)?{w}(?:\.|/)", (w,)) for w in HOST_LABELS),
    *(pattern_rule(f"path-{w}", rf"^[^/]*/(?:[^?#]*/)?{w}(?:/|$)", tuple(_TOKEN.findall(w))) for w in PATH_SEGMENTS),
    *(pattern_rule(f"ending-{w}", rf"^[^/]*/.*\.{w}$", (w,)) for w in FILE_ENDINGS),
    pattern_rule("session-path", r"^[^/]*/.*;(?:jsessionid|phpsessid)=", ("jsessionid",), ("phpsessid",)),
)

#: Rules that a task takes; a table of more is refused, as every task holds all of them.
MOST_RULES = 200_000


def rules_from(rules: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table: (verdict, address) for list rules, (name, pattern, literals array of arrays) for patterns of the policy; null columns tell which."""
    rows = rules.select("verdict", "address", "name", "pattern", "literals").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(list_rule(r["verdict"], r["address"]) if r["address"] is not None else pattern_rule(r["name"], r["pattern"], *map(tuple, r["literals"] or ())) for r in rows)


class RuleIndex:
    """Rules by the rarest literal of each alternative; rules with an alternative without a literal are candidates for every URL."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            entry = (r, re.compile(r.pattern, re.S))
            if r.alternatives and all(r.alternatives):
                for token in {min(a, key=lambda t: (counts.get(t, 0), t)) for a in r.alternatives}:
                    self.by_token[token].append(entry)
            else:
                self.always.append(entry)

    def candidates(self, address: str) -> list:
        found = list(self.always)
        for t in dict.fromkeys(_TOKEN.findall(address)):
            found += self.by_token.get(t, ())
        return found

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(list rule that decides or None, verdict)."""
        if not host:
            return None, "allow"
        address = host + path
        hits = [r for r, expression in self.candidates(address) if expression.search(address)]
        ranked = [r for r in hits if r.rank]
        if ranked:
            best = max(ranked, key=lambda r: (r.rank, r.name))
            return best.name, best.verdict
        return None, "block" if hits else "allow"


def split_url(url):
    """Columns for host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *_ASCII)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def token_counts(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each literal of the rules occurs: one row per literal reaches the driver."""
    wanted = sorted({t for r in rules for a in r.alternatives for t in a})
    found = F.array_intersect(F.split(F.lower(F.coalesce("url", F.lit(""))), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = LIST_RULES + POLICY) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`."""
    index = RuleIndex(rules, token_counts(pages, rules))

    @F.pandas_udf("rule string, verdict string")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame([index.judge(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.withColumn("judged", verdicts("host", "path")).select("page_id", "host", "path", "judged.rule", "judged.verdict")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    lists = ", ".join(f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in LIST_RULES)
    policy = " OR ".join(f"regexp_matches(address, '{r.pattern}', 's')" for r in POLICY)
    return rf"""
WITH r(rule, rule_host, rule_path, verdict) AS (VALUES {lists}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_ASCII[0]}', '{_ASCII[1]}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
a AS (SELECT *, host || path AS address FROM p),
m AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM a) a JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) AND host <> ''
  GROUP BY host, path)
SELECT a.page_id, a.host, a.path, m.rule,
       coalesce(m.verdict, CASE WHEN a.host <> '' AND ({policy}) THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN m USING (host, path)
"""


OP9_SQL = _sql()
