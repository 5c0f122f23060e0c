"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

A token budget flows from the root to domains, languages and sources. At each node the children
share it by weight; a child can't take more than ``max_epochs`` times the tokens below it, and what
it can't take goes to its siblings (water filling). Only when all siblings are full does a shortage
reach the parent's own siblings, since a parent's limit is the sum of its children's. Each leaf then
takes whole seeded epochs and a token prefix of one more, in the order of md5(seed:epoch:doc_id).

Main path: DataFrame functions only. The cumulative tokens of a leaf are taken in two levels (hash
buckets, then rows of the one bucket where the budget ends), so a leaf with a third of all rows is
spread over many tasks; at most ``MAX_BUCKETS`` bucket sums of one leaf meet in a task.

Edge cases: null lang or source form leaves of their own, apart from any text; null text has no tokens; documents
without tokens are taken with a whole epoch or where the prefix has room; repeated rows count each;
an empty table gives an empty result; weights missing from the tables are ``other``; columns of any name
pass through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawloom.llm.common import WORD_RE, row_key, stored, table, unwrapped, wrapped

#: Target weights (relative, whole numbers) by level; names that aren't listed get ``other``.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "other": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1, "other": 1}
SOURCE_WEIGHTS = {"other": 1}
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 2, 17
ROWS_PER_BUCKET, MAX_BUCKETS = 512, 65536


def domain_of(source: Column) -> Column:
    """d0..d3 by the number in a source's name; ``other`` without one."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.when(digits != "", digits).cast("int") % 4).cast("string")))


def node(name: Column) -> Column:
    """Key of a leaf's language or source, in which a missing name differs from every text."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit("?"))


def name_of(key: Column) -> Column:
    return F.when(key != "?", F.substr(key, F.lit(2)))


def weight(name: Column, weights: dict[str, int], prefix: str = "") -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in weights.items():
        if k != "other":
            out = out.when(name == prefix + k, F.lit(v))
    return out.otherwise(F.lit(weights.get("other", 1))).cast("long")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children with columns w (weight), cap and parent_budget: water filling by running sums.

    Sorted by cap/w, the full children form a prefix: child k is full if cap_k * (weights from k on)
    <= (budget - caps before k) * w_k. The rest share what is left by weight, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    group = Window.partitionBy(*parent)
    out = children.withColumn("_caps", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_ws", F.sum("w").over(after))
    full = F.col("cap").cast("decimal(38,0)") * F.col("_ws") <= (F.col("parent_budget") - F.col("_caps")).cast("decimal(38,0)") * F.col("w")
    out = out.withColumn("_full", full)
    out = out.withColumn("_left", F.col("parent_budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(group))
    out = out.withColumn("_w", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(group))
    share = F.expr("case when _w > 0 then cast(floor(cast(_left as decimal(28,0)) * cast(w as decimal(9,0)) div cast(_w as decimal(18,0))) as bigint) end")
    return out.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_caps", "_ws", "_full", "_left", "_w", "parent_budget", "w")


def leaf_budgets(leaves: DataFrame, budget_percent: int, max_epochs: int, weights=(DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """leaves: domain, lang, source, tokens, n. Adds the budget of each."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_percent / 100).cast("long").alias("parent_budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight(F.col("domain"), weights[0]))
    domains = fill(domains.crossJoin(F.broadcast(total)), [], "domain").select("domain", F.col("budget").alias("parent_budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight(F.col("lang"), weights[1], "="))
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    sources = leaves.withColumn("w", weight(F.col("source"), weights[2], "=")).join(langs, ["domain", "lang"])
    return fill(sources, ["domain", "lang"], "source").drop("cap")


def mix(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text_hash, domain, lang, source, tokens, epoch of every selected copy of a document."""
    keys = ["domain", "lang", "source"]
    domain = domain_of(F.col("source")) if domain is None else domain
    slim = stored(
        docs.select(
            *row_key(), domain.alias("domain"), node(F.col("lang")).alias("lang"), node(F.col("source")).alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("tokens"),
        ),
        "mix-rows",
    )
    leaves = slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    budgets = stored(leaf_budgets(leaves, budget_percent, max_epochs), "mix-leaves").select(
        *keys, F.expr("case when tokens > 0 then budget div tokens else 0 end").cast("int").alias("whole"),
        F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest"),
        F.least(F.greatest(F.ceil(F.col("n") / rows_per_bucket), F.lit(1)), F.lit(MAX_BUCKETS)).alias("buckets"),
    )
    rows = slim.join(budgets, keys)
    whole = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    ordered = rows.where("rest > 0").withColumn("epoch", F.col("whole"))
    ordered = ordered.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ordered = ordered.withColumn("_b", F.expr("cast(cast(conv(substr(_h, 1, 8), 16, 10) as bigint) * buckets div 4294967296 as int)"))
    sums = ordered.groupBy(*keys, "_b").agg(F.sum("tokens").alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))), "mix-buckets")
    ordered = ordered.join(sums, [*keys, "_b"])
    inside = ordered.where("_before + _sum <= rest")
    within = Window.partitionBy(*keys, "_b").orderBy("_h", F.col("doc_id").asc_nulls_first(), "tokens", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = ordered.where("_before <= rest and _before + _sum > rest").withColumn("_cum", F.col("_before") + F.sum("tokens").over(within)).where("_cum <= rest")
    cols = ["doc_id", "text_hash", *keys, "tokens", "epoch"]
    return whole.select(*cols).unionByName(inside.select(*cols)).unionByName(edge.select(*cols)).withColumns({"lang": name_of(F.col("lang")), "source": name_of(F.col("source"))})


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The selected rows with all columns of docs, one for each epoch that takes them."""
    picked = mix(docs, **options).groupBy("doc_id", "text_hash", "lang", "source").agg(F.collect_set("epoch").alias("epochs"))
    on = F.col("d.text_hash") == F.col("p.text_hash")
    for c in ("doc_id", "lang", "source"):
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
    out = wrapped(docs, *row_key(), F.col("lang"), F.col("source")).alias("d").join(picked.alias("p"), on)
    return unwrapped(out.select("d.row", F.explode("p.epochs")), docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def _case(column: str, weights: dict[str, int], prefix: str = "") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{prefix}{k}' THEN {v}" for k, v in weights.items() if k != "other") + f" ELSE {weights.get('other', 1)} END" if len(weights) > 1 else str(weights.get("other", 1))


def _fill(src: str, parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""(SELECT *, CASE WHEN f THEN cap ELSE CAST((parent_budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({part})) * w // sum(CASE WHEN f THEN 0 ELSE w END) OVER ({part}) AS BIGINT) END AS budget
 FROM (SELECT *, cap * sum(w) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
   <= (parent_budget - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f FROM {src}) q)"""


SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN dg = '' THEN 'other' ELSE 'd' || CAST(CAST(dg AS INT) % 4 AS VARCHAR) END AS domain, lang, source, tokens FROM (
  SELECT doc_id, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) AS dg, coalesce('=' || lang, '?') AS lang, coalesce('=' || source, '?') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST({MAX_EPOCHS} * sum(tokens) AS BIGINT) AS cap FROM d GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS w, (SELECT CAST(floor(sum(tokens) * {BUDGET_PERCENT} / 100) AS BIGINT) FROM leaves) AS parent_budget FROM leaves GROUP BY domain),
domf AS (SELECT domain, budget FROM {_fill("dom", "", "domain")}),
lng AS (SELECT l.domain, l.lang, CAST(sum(cap) AS BIGINT) AS cap, {_case("l.lang", LANGUAGE_WEIGHTS, "=")} AS w, any_value(budget) AS parent_budget FROM leaves l JOIN domf USING (domain) GROUP BY l.domain, l.lang),
lngf AS (SELECT domain, lang, budget FROM {_fill("lng", "domain", "lang")}),
src AS (SELECT leaves.*, {_case("source", SOURCE_WEIGHTS, "=")} AS w, budget AS parent_budget FROM leaves JOIN lngf USING (domain, lang)),
srcf AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM {_fill("src", "domain, lang", "source")}),
r AS (SELECT d.*, whole, rest FROM d JOIN srcf USING (domain, lang, source)),
w AS (SELECT doc_id, domain, lang, source, tokens, unnest(range(0, whole)) AS epoch FROM r),
e AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id, tokens ROWS UNBOUNDED PRECEDING) AS cum FROM r WHERE rest > 0)
SELECT doc_id, domain, CASE WHEN lang <> '?' THEN substr(lang, 2) END AS lang, CASE WHEN source <> '?' THEN substr(source, 2) END AS source, tokens, CAST(epoch AS INT) AS epoch FROM (SELECT doc_id, domain, lang, source, tokens, epoch FROM w
  UNION ALL SELECT doc_id, domain, lang, source, tokens, whole FROM e WHERE cum <= rest)
"""
