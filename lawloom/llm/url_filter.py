"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any matching URL must hold as whole
tokens. A rule is filed under the literal token that the fewest URLs hold; a URL's tokens fetch
their candidate rules and only those run their expressions. Native columns only, no Python.

Lists of up to ``IN_PLAN`` rules are literals of one projection: no shuffle, no join, so a hot host or
a hot URL costs no more than any other. Longer lists of any length are a table: the distinct URLs'
tokens are joined with the index (broadcast only where adaptive execution measures it small), the
candidates run their expressions, the best of each URL goes back to its rows.

Edge cases: a null URL or one without ``://`` has empty host and path and gets the default verdict,
unless a rule fits the empty subject; repeated rows give repeated results; an empty table gives an
empty result; further columns, whatever their names, are ignored unless listed in ``keep``; of rules
with one text the first listed counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import stored, table

#: Rules that fit into one projection.
IN_PLAN = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """text: as listed; verdict: allow or block; pattern: over host + path; tokens: literals that a match holds whole; named: whether it shows in the rule column."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    named: bool = True


def host_path_rule(text: str, verdict: str) -> Rule:
    """``example.org/en/1``: the host and all its subdomains, where the path starts with the rest.

    Host and path are joined by a space, which no host holds, to form the subject of the pattern.
    A last path token that the rule doesn't close is a prefix, so it can't serve as a literal.
    """
    host, slash, rest = text.partition("/")
    path = slash + rest
    closed = path if not path or not path[-1].isalnum() else re.sub(r"[0-9A-Za-z]+$", "", path)
    tokens = tuple(f"h:{t}" for t in re.findall(TOKEN, host)) + tuple(f"p:{t}" for t in re.findall(TOKEN, closed))
    return Rule(text, verdict, rf"^(?:[^\x00]*\.)?{re.escape(host)}\x00{re.escape(path)}", tokens)


def token_rule(name: str, verdict: str, token: str, side: str = "p") -> Rule:
    """A pattern of the method's own: the path (p) or the host (h) holds the token between non-alphanumerics."""
    inside = rf"\x00(?:.*[^0-9A-Za-z])?{token}(?:[^0-9A-Za-z]|$)" if side == "p" else rf"^(?:[^\x00]*[^0-9A-Za-z\x00])?{token}(?:[^0-9A-Za-z]|$)"
    return Rule(name, verdict, inside, (f"{side}:{token}",), named=False)


def ending_rule(ending: str) -> Rule:
    """The path ends in a file of this kind."""
    return Rule(f"file {ending}", "block", rf"\.{ending}$", (f"p:{ending}",), named=False)


#: The listed rules; the longest that fits wins.
RULES = (
    host_path_rule("org/", "allow"),
    host_path_rule("example.org/es/", "block"),
    host_path_rule("example.org/en/1", "block"),
    host_path_rule("com/fr/", "allow"),
    host_path_rule("com/de/", "block"),
)
#: Words that mark pages of no use for training: adult, gambling, pharmacy spam, piracy.
WORDS = (
    "casino", "porn", "torrent", "viagra", "warez", "xxx", "porno", "hentai", "camgirls", "escorts", "poker", "slots", "roulette", "sportsbook", "betting", "bingo", "jackpot", "cialis", "levitra", "xanax", "tramadol",
    "payday", "keygen", "cracked", "nulled", "phishing", "replica", "pharmacy",
)
#: Files that hold no text.
ENDINGS = ("exe", "apk", "msi", "dmg", "iso", "rar", "zip", "mp3", "mp4", "avi")
#: What the method judges where no listed rule fits: words in path or host, files, numeric hosts, endless paths. The last two have no literal and run everywhere.
OWN_RULES = (
    *(token_rule(f"token {t}", "block", t, side) for side in "ph" for t in WORDS),
    *map(ending_rule, ENDINGS),
    Rule("numeric host", "block", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\x00", (), named=False),
    Rule("endless path", "block", r"\x00(?:[^/]*/){16}", (), named=False),
)
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    tokens = lambda c, side: F.transform(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1), lambda t: F.concat(F.lit(side), t))
    return F.array_distinct(F.concat(tokens(host, "h:"), tokens(path, "p:")))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """URLs that hold each wanted token: one partial aggregate, at most len(wanted) rows reach the driver."""
    held = urls.select(F.explode(F.filter("tokens", lambda t: t.isin(wanted))).alias("t"))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest literal token; rules without a literal are candidates everywhere."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, own: tuple[Rule, ...] = OWN_RULES, default: str = DEFAULT, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule, verdict, n_candidates of every row.

    A listed rule beats the method's own rules; among listed ones the longest text wins, then the
    first listed.
    """
    every = (*rules, *own)
    if len(every) > IN_PLAN:
        return _filter_by_table(pages, every, default, url, keep)
    host, path = split_url(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index, always = build_index(every, token_counts(parts, sorted({t for r in every for t in r.tokens})))
    ints = lambda xs: F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<int>)")
    entries = F.create_map(*(x for t, own_ in sorted(index.items()) for x in (F.lit(t), ints(own_)))) if index else None
    fetched = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.element_at(entries, t), ints([])))) if index else ints([])
    subject = F.concat("host", F.lit("\0"), "path")

    def fits(i: Column) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for k, rule in enumerate(every):
            out = out.when(i == k, subject.rlike(f"(?s){rule.pattern}"))
        return out.otherwise(F.lit(False))

    def rank(i: Column) -> Column:
        ranks = F.array(*(F.struct(F.lit(int(r.named)).alias("named"), F.lit(len(r.text)).alias("len"), F.lit(-k).alias("k")) for k, r in enumerate(every)))
        return F.element_at(ranks, i + 1)

    out = parts.withColumn("candidates", F.array_distinct(F.concat(fetched, ints(always))))
    out = out.withColumn("best", F.array_max(F.transform(F.filter("candidates", fits), rank)))
    at = F.coalesce(-F.col("best.k"), F.lit(0)) + 1
    return out.select(
        *keep, "host", "path",
        F.when(F.col("best.named") == 1, F.element_at(F.array(*(F.lit(r.text) for r in every)), at)).alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.element_at(F.array(*(F.lit(r.verdict) for r in every)), at)).alias("verdict"),
        F.size("candidates").alias("n_candidates"),
    )


def _filter_by_table(pages: DataFrame, every: tuple[Rule, ...], default: str, url: str, keep: tuple[str, ...]) -> DataFrame:
    """The same with the rules as a table, for lists of any length."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), path.alias("path")).withColumn("token", F.explode(F.array_append(url_tokens(F.col("host"), F.col("path")), "")))
    urls = stored(urls, "url-tokens")
    rows = spark.createDataFrame([(i, r.text, r.verdict, r.pattern, list(r.tokens), int(r.named)) for i, r in enumerate(every)], "no long, text string, verdict string, pattern string, tokens array<string>, named int")
    # the rarest literal of each rule; a rule without one is filed under the empty token, which every URL has
    wanted = rows.select("no", F.explode_outer("tokens").alias("token"))
    counts = urls.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("m"))
    index = stored(rows.drop("tokens").join(rarest, "no").select("no", "text", "verdict", "pattern", "named", F.col("m.token").alias("token")), "url-index")
    candidates = urls.join(index, "token")
    fits = F.rlike(F.concat("host", F.lit("\0"), "path"), F.concat(F.lit("(?s)"), F.col("pattern")))
    rank = F.struct("named", F.length("text").alias("len"), (-F.col("no")).alias("k"), "text", "verdict")
    best = candidates.groupBy("url").agg(F.max(F.when(fits, rank)).alias("best"), F.count("*").cast("int").alias("n_candidates"))
    host, path = split_url(F.col(f"p.{url}"))
    out = pages.alias("p").join(best.alias("b"), F.col(f"p.{url}").eqNullSafe(F.col("b.url")), "left")
    return out.select(
        *(F.col(f"p.{k}") for k in keep), host.alias("host"), path.alias("path"), F.when(F.col("b.best.named") == 1, F.col("b.best.text")).alias("rule"),
        F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"), F.coalesce("b.n_candidates", F.lit(0)).alias("n_candidates"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(path, '(^|[^0-9A-Za-z])({"|".join(WORDS)})([^0-9A-Za-z]|$)') OR regexp_matches(host, '(^|[^0-9A-Za-z])({"|".join(WORDS)})([^0-9A-Za-z]|$)') OR regexp_matches(path, '\.({"|".join(ENDINGS)})$')
    OR regexp_matches(host, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}(:[0-9]+)?$') OR regexp_matches(path, '^([^/]*/){{16}}') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
