"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens flows from the root: each node's share is split among its
children by weight, and a child that can't use its share (its leaves' tokens times the epochs allowed) leaves the
rest to its siblings by their weights; only what a whole subtree can't use goes up. All levels are window sums
over the sorted ratios of capacity to weight, so no table of sources is collected. Each leaf then takes whole epochs
and, of one more, the prefix of its budget in an order seeded for that leaf and epoch. The prefix's end is found by
sums over ranges of the order, then within one range, so that a leaf that holds a third of all rows is never sorted.

Null domains, languages or sources are a child of their own, named `none`. Weights that aren't given are 1. Null or
empty texts have no tokens; a very long text is one number, its words. Equal order keys go by doc_id, none first; rows
that repeat a doc_id come together in the order, and where a budget ends among them, in all of them. An empty table
gives an empty one. Only doc_id, text, lang and source are read; other columns go, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEAF = ["domain", "language", "source"]
#: Hexadecimal digits of an order key that make a range: 65,536 ranges.
RANGE_DIGITS = 4


class Plan(NamedTuple):
    """Weights by domain, language and source; the budget as a share of the corpus's tokens; epochs at most; a seed."""

    domains: dict[str, float]
    languages: dict[str, float]
    sources: dict[str, float]
    share: float
    epochs: int
    seed: int
    #: Domains by source; other sources are of domain `rest`.
    domain_of: dict[str, str] = {}


#: What op10 and the pipeline mix to: src0, the largest source, is a domain of its own.
PLAN = Plan({"hub": 0.25, "rest": 0.75}, {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, {}, 0.9, 2, 7, {"src0": "hub"})


def leaves(docs: DataFrame, domain_of: dict[str, str] = PLAN.domain_of) -> DataFrame:
    """doc_id, domain, language, source and tokens (words); all others go."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))  # noqa: E731
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), "")).cast("long")
    domain = F.when(F.col("source").isNull(), "none").otherwise("rest")
    for source, own in sorted(domain_of.items()):
        domain = F.when(F.col("source") == source, own).otherwise(domain)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"), name("lang").alias("language"), name("source").alias("source"), words.alias("tokens"))


def order_key(plan: Plan) -> Column:
    """A document's place in its leaf's last, partial epoch: in hexadecimal, so that any SQL can make it."""
    return F.md5(F.concat_ws("|", F.lit(str(plan.seed)), "domain", "language", "source", F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))


def _weight(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(float(weight))).otherwise(out)
    return out


def _split(nodes: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """Adds given: of the parent's budget, by weight, at most cap, the rest to siblings. Needs cap and budget."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy("ratio", *[c for c in LEAF if c in nodes.columns and c not in parent]).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("weight", weight).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")))
    nodes = nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("full_up", (F.col("ratio") != float("inf")) & (F.col("cap_before") + F.col("ratio") * F.col("weight_left") <= F.col("budget") * (1 + 1e-12)))
    spent, open_weight = F.sum(F.when(F.col("full_up"), F.col("cap")).otherwise(0.0)).over(group), F.sum(F.when(F.col("full_up"), 0.0).otherwise(F.col("weight"))).over(group)
    given = F.when(F.col("full_up"), F.col("cap")).when(open_weight > 0, F.least(F.col("cap"), F.greatest(F.lit(0.0), (F.col("budget") - spent) * F.col("weight") / open_weight))).otherwise(0.0)
    return nodes.withColumn("given", given).drop("weight", "ratio", "cap_before", "weight_left", "full_up", "budget")


def budgets(sizes: DataFrame, plan: Plan) -> DataFrame:
    """domain, language, source, tokens and given (whole tokens), from the leaves' tokens."""
    sizes = sizes.withColumn("cap", (F.col("tokens") * plan.epochs).cast("double"))
    total = sizes.agg(F.sum("tokens").alias("all")).select((F.coalesce("all", F.lit(0)) * plan.share).alias("budget"))
    top = sizes.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))  # a single row
    top = _split(top, [], _weight("domain", plan.domains))
    middle = sizes.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
    middle = _split(middle.join(top.select("domain", F.col("given").alias("budget")), "domain"), ["domain"], _weight("language", plan.languages))
    leaf = sizes.join(middle.select("domain", "language", F.col("given").alias("budget")), ["domain", "language"])
    leaf = _split(leaf, ["domain", "language"], _weight("source", plan.sources))
    return leaf.select(*LEAF, "tokens", F.floor(F.col("given") + 1e-6).alias("given"))


def cuts(keyed: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf: full (whole epochs), rest (tokens of one more), and the order key and doc_id where that one ends."""
    sizes = keyed.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    given = budgets(sizes, plan).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(0))
    given = materialise(given.select(*LEAF, "full", (F.col("given") - F.col("full") * F.col("tokens")).alias("rest")), "budgets")
    some = keyed.join(given.where("rest > 0"), LEAF).withColumn("key", order_key(plan)).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = some.groupBy(*LEAF, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("to", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("range")))
    crossing = ranges.where("to >= rest AND to - n < rest").select(*LEAF, "range", (F.col("to") - F.col("n")).alias("before"))
    fine = some.join(crossing, [*LEAF, "range"])
    fine = fine.withColumn("to", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("key", "doc_id")))
    last = fine.where("to >= rest").groupBy(*LEAF).agg(F.min(F.struct("key", "doc_id", (F.col("to") - F.col("tokens")).alias("start"))).alias("last"))
    return given.join(last, LEAF, "left").select(*LEAF, "full", "rest", F.col("last.key").alias("last_key"), F.col("last.doc_id").alias("last_id"), F.col("last.start").alias("last_start"))


def choose(keyed: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """doc_id, domain, language, source, tokens, epoch (from 0) and take_tokens: one row per epoch that takes the document.

    keyed: what leaves() gives, stored, for it is read several times.

    take_tokens is less than tokens only for the document in which a leaf's budget ends.
    """
    found = keyed.join(cuts(keyed, plan), LEAF).withColumn("key", order_key(plan))
    at, end = F.struct("key", "doc_id"), F.struct(F.col("last_key").alias("key"), F.col("last_id").alias("doc_id"))
    more = F.coalesce((F.col("rest") > 0) & (at <= end), F.lit(False))
    found = found.withColumn("epochs", (F.col("full") + F.when(more, 1).otherwise(0)).cast("int")).where("epochs > 0")
    found = found.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    ends = more & (at == end) & (F.col("epoch") == F.col("full"))
    take = F.when(ends, F.least(F.col("tokens"), F.greatest(F.lit(0), F.col("rest") - F.col("last_start")))).otherwise(F.col("tokens"))
    return found.select("doc_id", *LEAF, "tokens", "epoch", take.cast("long").alias("take_tokens"))


def op10(docs: DataFrame) -> DataFrame:
    """The mixture of the whole table."""
    return choose(materialise(leaves(docs), "tokens"))


def _split_sql(nodes: str, parent: str, weight: str) -> str:
    """SQL of `given` for nodes (cap, budget), found without windows over ratios: by trying each ratio as the level."""
    same = " AND ".join(f"o.{c} = n.{c}" for c in parent.split(", ")) if parent else "true"
    weighted = f"(SELECT *, {weight} AS weight FROM {nodes})"
    # at level x each child has min(cap, x * weight); the level is that at which these spend the budget
    spent = f"(SELECT sum(least(o.cap, n.cap / n.weight * o.weight)) FROM {weighted} o WHERE {same})"
    level = f"""(SELECT CASE WHEN sum(o.cap) <= n.budget THEN NULL ELSE
        (n.budget - coalesce(sum(o.cap) FILTER (o.full_up), 0)) / sum(o.weight) FILTER (NOT o.full_up) END FROM (SELECT n.*, {spent} <= n.budget AS full_up FROM {weighted} n) o WHERE {same})"""
    return f"(SELECT n.*, least(n.cap, coalesce({level} * n.weight, n.cap)) AS given FROM {weighted} n)"


def oracle(plan: Plan = PLAN) -> str:
    """DuckDB SQL; weights must be above 0."""

    def case(column: str, weights: dict[str, float]) -> str:
        whens = " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in weights.items())
        return f"CASE {column} {whens} ELSE CAST(1 AS DOUBLE) END" if weights else "CAST(1 AS DOUBLE)"

    domain = " ".join(f"WHEN source = '{k}' THEN '{d}'" for k, d in plan.domain_of.items())
    key = f"md5(concat_ws('|', '{plan.seed}', domain, language, source, CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'none')))"
    return rf"""
WITH t AS (SELECT doc_id, CASE {domain} WHEN source IS NULL THEN 'none' ELSE 'rest' END AS domain, coalesce(lang, 'none') AS language, coalesce(source, 'none') AS source,
                  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	
]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM documents),
     leaf AS (SELECT domain, language, source, sum(tokens) AS tokens, CAST(sum(tokens) * {plan.epochs} AS DOUBLE) AS cap FROM t GROUP BY ALL),
     top AS (SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) FROM leaf) * CAST({plan.share} AS DOUBLE) AS budget FROM leaf GROUP BY domain),
     top_given AS {_split_sql("top", "", case("domain", plan.domains))},
     middle AS (SELECT l.domain, l.language, sum(l.cap) AS cap, any_value(g.given) AS budget FROM leaf l JOIN top_given g USING (domain) GROUP BY l.domain, l.language),
     middle_given AS {_split_sql("middle", "domain", case("language", plan.languages))},
     low AS (SELECT l.*, g.given AS budget FROM leaf l JOIN middle_given g USING (domain, language)),
     low_given AS {_split_sql("low", "domain, language", case("source", plan.sources))},
     g AS (SELECT domain, language, source, CAST(floor(given + 1e-6) AS BIGINT) AS given, CAST(CASE WHEN tokens > 0 THEN CAST(floor(given + 1e-6) AS BIGINT) // tokens ELSE 0 END AS BIGINT) AS whole, tokens AS leaf_tokens FROM low_given),
     k AS (SELECT t.*, whole, CAST(given - whole * leaf_tokens AS BIGINT) AS rest, {key} AS key FROM t JOIN g USING (domain, language, source)),
     o AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before FROM k),
     e AS (SELECT *, unnest(range(CAST(whole + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM o)
SELECT doc_id, domain, language, source, tokens, CAST(epoch AS INT) AS epoch, CAST(CASE WHEN epoch = whole THEN least(tokens, rest - before) ELSE tokens END AS BIGINT) AS take_tokens FROM e"""
