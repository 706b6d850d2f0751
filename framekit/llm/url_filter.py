"""URL filters: host and path rules, then a weighted vocabulary of terms.

All terms go into one Aho-Corasick automaton. A match counts only between
boundaries: the characters beside it aren't letters or digits. One strict term
rejects a URL, and so do several distinct soft ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache
from pathlib import Path

import ahocorasick
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

#: The vocabulary: a term, its weight (strict or soft) and its topic in each line.
TERMS = Path(__file__).with_name("url_terms.tsv")
#: Distinct soft terms that reject a URL.
SOFT_HITS = 2
#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@cache
def terms(weight: str, path: Path = TERMS) -> tuple[str, ...]:
    """The vocabulary's terms of one weight; read on the driver, executors get them with the function."""
    rows = (line.split("\t") for line in path.read_text(encoding="utf-8").splitlines() if line and not line.startswith("#"))
    return tuple(term for term, own, _ in rows if own == weight)


def __getattr__(name: str) -> tuple[str, ...]:
    if name in ("STRICT", "SOFT"):
        return terms(name.lower())
    raise AttributeError(name)


class Vocabulary:
    """Counts distinct strict and soft terms in a text."""

    def __init__(self, strict: Iterable[str] | None = None, soft: Iterable[str] | None = None, soft_hits: int = SOFT_HITS):
        self.soft_hits = soft_hits
        strict, soft = terms("strict") if strict is None else strict, terms("soft") if soft is None else soft
        self.machine = ahocorasick.Automaton()
        for weight, own in ((False, soft), (True, strict)):
            for term in own:
                if term:
                    self.machine.add_word(term.lower(), (term.lower(), weight))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, text: str | None) -> tuple[list[str], list[str]]:
        """Distinct strict and soft terms between boundaries, sorted."""
        found: tuple[set, set] = set(), set()
        if text and not self.empty:
            low = text.lower()
            for end, (term, strict) in self.machine.iter(low):
                start = end - len(term) + 1
                if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                    found[not strict].add(term)
        return sorted(found[0]), sorted(found[1])

    def rejects(self, text: str | None) -> bool:
        strict, soft = self.hits(text)
        return bool(strict) or len(soft) >= self.soft_hits


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; "" without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host, or a domain over it, and the path's start; else NULL."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge_urls(
    df: DataFrame,
    url_col: str = "url",
    keep: list[str] | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] | None = None,
    soft: Sequence[str] | None = None,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """Append ``host``, ``path``, ``rule``, ``strict_terms``, ``soft_terms`` and ``verdict``.

    A rule that fits decides; otherwise the vocabulary does, over the whole URL.
    NULL, empty and scheme-less URLs have an empty host and path; their text is
    judged by its terms all the same (NULL: allow). Rows stay as they are, also
    repeated ones; input columns named like an output give way to it. No shuffle;
    URLs of any length are read whole. ``strict`` and ``soft`` are the
    vocabulary's by default.
    """
    strict, soft = terms("strict") if strict is None else strict, terms("soft") if soft is None else soft
    strings = T.ArrayType(T.StringType())
    fields = [T.StructField("strict_terms", strings), T.StructField("soft_terms", strings)]

    def make():
        own = Vocabulary(strict, soft, soft_hits)

        def apply(urls):
            found = [own.hits(u) for u in urls]
            return {"strict_terms": [x[0] for x in found], "soft_terms": [x[1] for x in found]}

        return apply

    taken = {"host", "path", "rule", "verdict", "strict_terms", "soft_terms"}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    rows = df.select(*[f"`{c}`" for c in names], F.col(f"`{url_col}`").alias("__url"))
    marked = annotate(rows, make, fields, "__url", None)
    url = F.col("__url")
    marked = marked.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    marked = marked.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when((F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_hits), F.lit("block")).otherwise(F.lit("allow"))
    ruled = own
    for rule, verdict in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    return marked.select(*[f"`{c}`" for c in names], "host", "path", "rule", "strict_terms", "soft_terms", ruled.alias("verdict"))


def oracle(rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] | None = None, soft: Sequence[str] | None = None, soft_hits: int = SOFT_HITS) -> str:
    """The query's rows in SQL: one pattern a term instead of the automaton."""
    strict, soft = terms("strict") if strict is None else strict, terms("soft") if soft is None else soft
    found = lambda terms: " + ".join(f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^\\pL\\pN]){t}([^\\pL\\pN]|$)') AS INT)" for t in terms)
    cases = ""
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        cases += f" WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + start}') THEN '{rule}'"
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    return f"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE{cases} END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN {found(strict)} > 0 OR {found(soft)} >= {soft_hits} THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of all pages."""
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict")
