"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host with a path prefix, or a pattern with ``*`` for any run of characters.  Each becomes a regular
expression over the canonical URL (a dot, the host with A-Z lower-cased, then everything after the host) and a
list of literal tokens: the runs of ASCII letters and digits that stand whole in every URL the rule fits.  A
rule is filed under the one that the fewest URLs hold, counted over all URLs.  A URL is split into its tokens,
these fetch the rules filed under them, and only those run their expressions.  Rules without such a token
are asked of every URL.

Up to INLINE_RULES rules the index is one constant of the plan, an array of hash buckets: a look-up is an array
access, no row moves, and the other columns stay where they are.  More rules are joined by token to the
distinct URLs.  Both give the same rows.

Of the rules that fit, one with a host and path beats a pattern, then the longest wins, then block beats allow,
then the smaller name.  Where none fits the verdict is allow.

Defined results: a URL that is null or has no ``://`` has an empty host and path and fits no rule with a token.
Repeated rows are judged each for itself, null ids are carried.  Columns named like results are replaced, all
others are kept.  Without rules every URL is allowed; no rows in, no rows out.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.registry import query, table
from gridloom.session import broadcast_if_small

#: Most rules whose index is a constant of the plan.
INLINE_RULES = 5_000
_TOKEN = re.compile("[A-Za-z0-9]+")
_INDEX = "array<array<struct<token:string,place:int,pattern:string>>>"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``exact`` tells a host and path from a pattern."""

    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    exact: bool

    @property
    def order(self) -> tuple:
        """Ascending: the last one wins."""
        return self.exact, len(self.name), self.verdict == "block", tuple(-ord(c) for c in self.name), self.verdict


def _verdict(verdict: str) -> str:
    if verdict not in ("allow", "block"):
        raise ValueError(f"a rule allows or blocks, not {verdict!r}")
    return verdict


def host_rule(verdict: str, host: str, path: str = "") -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    if not host or re.search("[/?#]", host) or re.search("[?#]", path) or (path and not path.startswith("/")):
        raise ValueError(f"not a host and a path: {host!r}, {path!r}")
    low = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    # The path goes on after a prefix, so a token at its end may be part of a longer one.
    whole = [m.group() for m in _TOKEN.finditer(low)] + [m.group() for m in _TOKEN.finditer(path) if m.end() < len(path)]
    after = re.escape(path) if path else r"(?=[/?#]|\z)"
    return Rule(_verdict(verdict), low + path, rf"^[^/?#]*\.{re.escape(low)}{after}", tuple(dict.fromkeys(whole)), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """Fits URLs that hold ``pattern`` somewhere after the scheme; ``*`` is any run of characters."""
    if not pattern.strip("*"):
        raise ValueError("a pattern needs a literal part")
    whole = [m.group() for m in _TOKEN.finditer(pattern) if 0 < m.start() and m.end() < len(pattern) and "*" not in (pattern[m.start() - 1], pattern[m.end()])]
    return Rule(_verdict(verdict), pattern, "(?s)" + ".*".join(map(re.escape, pattern.split("*"))), tuple(dict.fromkeys(whole)), False)


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """What rules are compared with; empty without a scheme."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("."), host(url), rest)).otherwise("")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.split(text, "[^A-Za-z0-9]+"))


def rarest(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """Number of URLs that hold each token of the rules: one pass, partly summed before it is shuffled."""
    named = sorted({t for r in rules for t in r.tokens})
    if not named:
        return {}
    wanted = broadcast_if_small(urls.sparkSession.createDataFrame([(t,) for t in named], "token string"), len(named))
    held = urls.select(F.explode(tokens(canonical(F.col(f"`{url}`")))).alias("token")).join(wanted, "token")
    found = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most the rules' tokens
    return {t: found.get(t, 0) for t in named}


def filed(rules: Sequence[Rule], counts: dict[str, int]) -> list[tuple[str, int, Rule]]:
    """(token, place in the order of precedence from 1, rule); a rule without tokens is filed under ''."""
    ordered = sorted(set(rules), key=lambda r: r.order)
    return [(min(r.tokens, key=lambda t: (counts[t], t), default=""), i + 1, r) for i, r in enumerate(ordered)]


def _inline(target: Column, index: list[tuple[str, int, Rule]]) -> Column:
    """Place of the winning rule, 0 where none fits."""
    size = 1 << max(len(index), 1).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    always = []
    for token, place, rule in index:
        entry = {"token": token, "place": place, "pattern": rule.pattern}
        (buckets[zlib.crc32(token.encode()) % size] if token else always).append(entry)
    table_ = F.from_json(F.lit(json.dumps([*buckets, always])), _INDEX)
    bucket = lambda t: F.get(table_, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int"))
    fetched = F.flatten(F.transform(tokens(target), lambda t: F.filter(bucket(t), lambda r: r["token"] == t)))
    asked = F.concat(fetched, F.get(table_, F.lit(size)))
    fit = F.filter(asked, lambda r: F.rlike(target, r["pattern"]))
    return F.coalesce(F.array_max(F.transform(fit, lambda r: r["place"])), F.lit(0))


def _joined(urls: DataFrame, url: str, index: list[tuple[str, int, Rule]]) -> DataFrame:
    """(url, place) of the distinct URLs that some rule fits."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(t, p, r.pattern) for t, p, r in index], "token string, place int, pattern string")
    given = urls.select(F.col(f"`{url}`").alias("url")).distinct().withColumn("target", canonical(F.col("url")))
    # The empty token fetches the rules that are asked of every URL.
    held = given.withColumn("token", F.explode(F.array_union(F.filter(tokens(F.col("target")), lambda t: t != ""), F.array(F.lit("")))))
    fit = held.join(broadcast_if_small(rules, len(index)), "token").where(F.rlike("target", "pattern"))
    return fit.groupBy("url").agg(F.max("place").alias("place"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """``pages`` with host, path, rule (of a host and path, else null), pattern (else null) and verdict."""
    index = filed(rules, rarest(pages, rules, url))
    names = [r.name if r.exact else None for _, _, r in index], [None if r.exact else r.name for _, _, r in index]
    at = lambda values: F.get(F.from_json(F.lit(json.dumps([None, *values])), "array<string>"), F.col("__place"))
    address = F.col(f"`{url}`").cast("string")
    if len(index) <= inline:
        out = pages.withColumn("__place", _inline(canonical(address), index))
        verdict = F.coalesce(at([r.verdict for _, _, r in index]), F.lit("allow"))
        found = {"rule": at(names[0]), "pattern": at(names[1]), "verdict": verdict}
    else:
        told = pages.sparkSession.createDataFrame(
            [(p, a, b, r.verdict) for (_, p, r), a, b in zip(index, *names, strict=True)],
            "place int, __rule string, __pattern string, __verdict string",
        )
        best = _joined(pages, url, index).join(broadcast_if_small(told, len(index)), "place").drop("place").withColumnRenamed("url", "__url")
        out = pages.join(best, address == F.col("__url"), "left").drop("__url")
        found = {"rule": F.col("__rule"), "pattern": F.col("__pattern"), "verdict": F.coalesce("__verdict", F.lit("allow"))}
    out = out.withColumns({"__host": host(address), "__path": path(address)} | {f"__{k}": v for k, v in found.items()})
    names_ = ["host", "path", *found]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names_]
    return out.select(*kept, *(F.col(f"__{c}").alias(c) for c in names_))


def allowed(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with their own columns only."""
    spare = pages.withColumn("__url", F.col(f"`{url}`"))
    judged = judge(spare.select("__url", F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("__row")), rules, "__url")
    return judged.where("verdict = 'allow'").select(*(F.col("__row")[c].alias(c) for c in pages.columns))


#: The hosts and paths that the query decides.
HOSTS = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Patterns for all other URLs: copies of a page under tracking parameters, pages without text of
#: their own, files that are not pages; a print view is allowed in spite of its parameters.
PATTERNS = [
    ("block", "?utm_source="), ("block", "&utm_source="), ("block", "?*sessionid="), ("block", "/wp-admin/"), ("block", "/wp-login."), ("block", "/login/"),
    ("block", "/signup/"), ("block", "/cart/"), ("block", "/checkout/"), ("block", "/search?"), ("block", "/tag/"), ("block", "/feed/"), ("block", "/ads/"),
    ("block", ".jpg?"), ("block", ".png?"), ("block", "/cgi-bin/"), ("block", ".doubleclick."), ("allow", "/print/*utm_source="),
]


def _sql() -> str:
    """The rules one by one, those that win first."""
    rules = sorted(HOSTS, key=lambda r: (-len(r[1] + r[2]), r[0] == "allow"))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "\n".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    verdict = "\n".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    likes = sorted(PATTERNS, key=lambda r: (-len(r[1]), r[0] == "allow"))
    like = lambda p: "'%" + p.replace("_", "!_").replace("*", "%") + "%' ESCAPE '!'"
    other = "\n".join(f"WHEN rest LIKE {like(p)} THEN '{v}'" for v, p in likes)
    none = "\n".join(f"WHEN {f} THEN NULL" for f in fits)
    pattern = "\n".join(f"WHEN rest LIKE {like(p)} THEN '{p}'" for _, p in likes)
    return rf"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
        halves AS (SELECT page_id, after, regexp_extract(after, '^[^/?#]*') AS raw FROM cut),
        parts AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                         regexp_extract(substr(after, length(raw) + 1), '^[^?#]*') AS path,
                         CASE WHEN after = '' THEN '' ELSE substr(after, length(raw) + 1) END AS tail, after FROM halves),
        whole AS (SELECT page_id, host, path, CASE WHEN after = '' THEN '' ELSE '.' || host || tail END AS rest FROM parts)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {other} ELSE 'allow' END AS verdict,
               CASE {none} {pattern} END AS pattern
        FROM whole"""


@query("op13_url_filters", _sql())
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(*r) for r in HOSTS] + [pattern_rule(*r) for r in PATTERNS]
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "pattern")
