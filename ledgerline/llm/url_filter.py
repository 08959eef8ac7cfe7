"""URL filter: allow/block rules by host and path first, then a weighted URL vocabulary.

An Aho-Corasick automaton finds every strict and soft term of the vocabulary in one pass over the
lower-cased URL. A hit counts only at word boundaries (the neighbouring characters are not
letters or digits). One strict term, or ``soft_limit`` distinct soft terms, rejects the URL.

Nulls and odd rows: a null URL, or one without ``://``, has empty host and path, fits no rule; its
verdict is the vocabulary's (a null URL has no terms, so ``allow``). Repeated rows are judged
row by row; other columns of the input pass through untouched, whatever their names, because the
operator returns one struct column under a name of the caller's choice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, table

# Default vocabulary: host and path words of adult, gambling and scam sites.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "sexcam", "onlinecasino",
                "viagra", "warez", "phishing")
SOFT_TERMS = ("adult", "sex", "sexy", "nude", "erotic", "escort", "casino", "poker", "betting",
              "jackpot", "pills", "torrent", "crack", "keygen", "dating", "webcam")
SOFT_LIMIT = 2


class Rule(NamedTuple):
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"),
         Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
         Rule("block", "net", "/fr/"))

AUTHORITY = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, or null; of two rules of equal
    length the one with the longer host wins. The rules are a short list held in the plan."""
    if not rules:
        return F.lit(None).cast("struct<name:string,verdict:string>")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(len(r.name)).alias("size"), F.lit(len(r.host)).alias("host_size"),
                            F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
            for r in rules]
    return F.array_max(F.array(*fits))


def vocabulary_hits(url: Column, strict: Sequence[str], soft: Sequence[str]) -> Column:
    """Struct (n_strict, n_soft): distinct strict and soft terms found at word boundaries."""
    terms = {t.lower(): True for t in soft} | {t.lower(): False for t in strict}

    @F.pandas_udf("n_strict int, n_soft int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        machine = ahocorasick.Automaton()
        for term, is_soft in terms.items():
            machine.add_word(term, (term, is_soft))
        if terms:
            machine.make_automaton()

        def count(url: str | None) -> tuple[int, int]:
            found: tuple[set, set] = (set(), set())
            if url and terms:
                text = url.lower()
                for end, (term, is_soft) in machine.iter(text):
                    start = end + 1 - len(term)
                    if (start == 0 or not text[start - 1].isalnum()) and (
                            end + 1 == len(text) or not text[end + 1].isalnum()):
                        found[is_soft].add(term)
            return len(found[0]), len(found[1])

        for batch in urls:
            yield pd.DataFrame([count(u) for u in batch], columns=["n_strict", "n_soft"]).astype("int32")

    return hits(url)


def judge_urls(df: DataFrame, url: str = "url", out: str = "url_verdict", rules: Sequence[Rule] = RULES,
               strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
               soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add the struct column ``out``: host, path, rule, verdict, n_strict, n_soft. One narrow pass,
    no shuffle. A rule decides alone; without one the vocabulary does."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    hits = vocabulary_hits(F.col(url), strict, soft)
    judged = df.withColumn(out, F.struct(host.alias("host"), path.alias("path"), hits.alias("hits")))
    rule = best_rule(F.col(f"{out}.host"), F.col(f"{out}.path"), rules)
    rejected = (F.col(f"{out}.hits.n_strict") >= 1) | (F.col(f"{out}.hits.n_soft") >= soft_limit)
    method = F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn(out, F.struct(
        F.col(f"{out}.host"), F.col(f"{out}.path"), rule["name"].alias("rule"),
        F.coalesce(rule["verdict"], method).alias("verdict"),
        F.col(f"{out}.hits.n_strict"), F.col(f"{out}.hits.n_soft")))


def op8_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` URL judged: page_id, host, path, rule, verdict, n_strict, n_soft."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "url_verdict.*")


def _sql_terms(terms: Sequence[str]) -> str:
    """SQL for the number of distinct terms found in ``low`` at word boundaries."""
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') AS INTEGER)"
                      for t in terms)


ORACLE = f"""
WITH u AS (
  SELECT page_id, coalesce(lower(url), '') AS low,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), p AS (
  SELECT page_id, low, translate(raw_host, '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host, path FROM u
), r AS (
  SELECT page_id, host, path, {_sql_terms(STRICT_TERMS)} AS n_strict, {_sql_terms(SOFT_TERMS)} AS n_soft,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM r
"""
