"""Mixing of sources to target weights by hierarchical budgeting, in SQL expressions.

The tokens that the corpus offers are summed by leaf of a domain - language - source tree and by bin of a seeded order. Budgets go down the tree: at
each node, children share its budget by weight; a child that can't use its share leaves the rest to its siblings, by weight again, and
only what all of them can't use is missing at the node itself, where its own siblings have already been given it. Each leaf takes
the prefix of its seeded epochs that its budget covers. The prefix is found by bins first; rows are ordered within one bin a leaf only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, stage

DOMAINS = {"web": 0.5, "reference": 0.3, "forum": 0.2}
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: The weight of a language that LANGUAGES doesn't name (null too).
OTHER = 0.05
SHARE, EPOCHS, SEED = 0.6, 2, 7
LEAF = ["domain", "lang", "source"]
#: Hexadecimal digits of the order key that name a bin, as many bins a leaf as 16 to this power.
BIN_DIGITS = 3
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def by_number(source: Column) -> Column:
    """The domain that follows from the number a source's name ends with, modulo three."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,6})$", 1).try_cast("int"), F.lit(0)) % 3
    names = list(DOMAINS)
    return F.when(number == 0, names[0]).when(number == 1, names[1]).otherwise(names[2])


@dataclass(frozen=True)
class Weights:
    """Positive weights of domains, of languages in a domain and of sources in a language; what isn't named has ``other``, a source 1. ``domain_of``: a source's domain."""

    domains: dict[str, float] = field(default_factory=lambda: DOMAINS)
    languages: dict[str, float] = field(default_factory=lambda: LANGUAGES)
    sources: dict[str, float] = field(default_factory=dict)
    other: float = OTHER
    domain_of: Callable[[Column], Column] = by_number

    def __post_init__(self) -> None:
        if min([self.other, *self.domains.values(), *self.languages.values(), *self.sources.values()]) <= 0:
            raise ValueError("weights must be positive")


DEFAULT = Weights()


def _weight(named: dict[str, float], key: str, other: float) -> Column:
    if not named:
        return F.lit(float(other))
    known = F.create_map(*[F.lit(x) for k, v in named.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, F.col(key)), F.lit(float(other)))


def leaf(docs: DataFrame, weights: Weights = DEFAULT) -> list[Column]:
    """domain, lang, source of each row; null keys are ``?``."""
    return [F.coalesce(weights.domain_of(docs["source"]), F.lit("?")).alias("domain"), F.coalesce(docs["lang"], F.lit("?")).alias("lang"), F.coalesce(docs["source"], F.lit("?")).alias("source")]


def tree(docs: DataFrame, weights: Weights = DEFAULT) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *leaf(docs, weights), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(BLANK_WORD)).cast("bigint").alias("n_tokens"))


def order_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """32 hexadecimal digits that order a leaf's documents in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("?"))).cast("binary"))


def _full_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.concat(order_key(epoch, doc_id, seed), F.lpad(F.coalesce(doc_id.cast("string"), F.lit("?")), 20, "0"))


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (.., weight, supply, parent_budget) with ``budget``: the parent's budget by weight, none above its supply, as much of it used as can be.

    In the order of supply for weight, a child is filled if its supply is below its share of what is left by those before it; from
    the first one that isn't, all take their share by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), F.col("supply"), *[c for c in LEAF if c in nodes.columns])
    before = F.sum("supply").over(order) - F.col("supply")
    heavy = F.sum("weight").over(Window.partitionBy(*parent)) - F.sum("weight").over(order) + F.col("weight")
    level = (F.col("parent_budget") - before) / heavy
    full = F.col("supply") <= F.col("weight") * level
    out = nodes.withColumn("level", level).withColumn("full", full)
    cut = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return out.withColumn("budget", F.when(F.col("full"), F.col("supply")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * cut))).drop("level", "full")


def budgets(leaves: DataFrame, share_of_all: float, epochs: int, weights: Weights = DEFAULT) -> DataFrame:
    """domain, lang, source, budget (whole tokens) from leaves (domain, lang, source, tokens)."""
    supply = leaves.withColumn("supply", (F.col("tokens") * epochs).cast("double"))
    langs = supply.groupBy("domain", "lang").agg(F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("supply").alias("supply"))
    total = Window.partitionBy("root")
    top = domains.withColumn("root", F.lit(1)).withColumn("weight", _weight(weights.domains, "domain", weights.other)).withColumn("parent_budget", F.floor(F.sum("supply").over(total) / epochs * share_of_all).cast("double"))
    top = share(top, ["root"]).select("domain", F.col("budget").alias("parent_budget"))
    mid = share(langs.join(top, "domain").withColumn("weight", _weight(weights.languages, "lang", weights.other)), ["domain"])
    low = supply.join(mid.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"]).withColumn("weight", _weight(weights.sources, "source", 1.0))
    return share(low, ["domain", "lang"]).select(*LEAF, "tokens", F.floor(F.col("budget") + 1e-3).cast("bigint").alias("budget"))


def cuts(rows: DataFrame, share_of_all: float, epochs: int, seed: int, weights: Weights = DEFAULT) -> DataFrame:
    """domain, lang, source, epochs_whole, cut: whole epochs are taken whole, and in the next one the keys up to ``cut`` (null: none).

    ``rows`` are those of :func:`tree`. The prefix is the longest one whose tokens don't exceed the budget.
    """
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    planned = stage(
        budgets(leaves, share_of_all, epochs, weights).withColumn("epochs_whole", F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(epochs).cast("int")),
        "budgets",
    )
    partial = planned.where((F.col("epochs_whole") < epochs) & (F.col("tokens") > 0)).withColumn("rest", F.col("budget") - F.col("epochs_whole") * F.col("tokens")).select(*LEAF, "epochs_whole", "rest")
    keyed = rows.join(partial, LEAF).withColumn("key", _full_key(F.col("epochs_whole"), F.col("doc_id"), seed)).withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = keyed.groupBy(*LEAF, "bin").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEAF).orderBy("bin")
    bins = stage(bins.withColumn("upto", F.sum("t").over(run)), "bins")
    whole = bins.where("upto <= rest").groupBy(*LEAF).agg(F.concat(F.max("bin"), F.lit("g")).alias("whole"))
    split = bins.where("upto > rest").groupBy(*LEAF).agg(F.min("bin").alias("bin"), F.min_by(F.col("rest") - (F.col("upto") - F.col("t")), "bin").alias("left"))
    inside = keyed.drop("rest").join(split, [*LEAF, "bin"]).withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*LEAF, "bin").orderBy("key")))
    ends = inside.where("upto <= left").groupBy(*LEAF).agg(F.max("key").alias("last"))
    out = stage(planned.join(whole, LEAF, "left").join(ends, LEAF, "left").select(*LEAF, "epochs_whole", F.greatest("whole", "last").alias("cut"), "budget"), "cuts")
    discard(planned, bins)
    return out


def mix(docs: DataFrame, share_of_all: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: Weights = DEFAULT) -> DataFrame:
    """Per selected document and epoch: doc_id, epoch, domain, lang, source, n_tokens.

    ``share_of_all`` of the corpus's words is the target. A document is offered once in each of ``epochs`` seeded orders. Null and empty texts have no words and
    cost nothing. Null languages and sources are the leaf ``?``. Rows that repeat an id stand side by side in the order and are each counted.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = stage(tree(docs, weights), "leaves")
    return _selected(rows, cuts(rows, share_of_all, epochs, seed, weights), epochs, seed)


def _selected(rows: DataFrame, ends: DataFrame, epochs: int, seed: int) -> DataFrame:
    key = _full_key(F.col("epoch"), F.col("doc_id"), seed)
    offered = rows.join(ends, LEAF).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(epochs - 1), F.col("epochs_whole")))))
    taken = (F.col("epoch") < F.col("epochs_whole")) | (key <= F.col("cut"))
    return offered.where(taken).select("doc_id", "epoch", *LEAF, "n_tokens")


def select_documents(docs: DataFrame, share_of_all: float, seed: int = SEED, weights: Weights = DEFAULT) -> DataFrame:
    """``docs`` with its own columns, whatever their names: the rows that one epoch of :func:`mix` takes.

    A row's leaf and key decide, so the texts are not shuffled: only the cuts, one row a leaf, are joined to them.
    """
    rows = stage(tree(docs, weights), "leaves")
    ends = cuts(rows, share_of_all, 1, seed, weights)
    discard(rows)
    *keys, whole, cut = fresh(docs, *[f"leaf_{c}" for c in LEAF], "whole", "cut")
    ends = ends.where("epochs_whole > 0 or cut is not null").select(*[F.col(c).alias(k) for c, k in zip(LEAF, keys, strict=True)], F.col("epochs_whole").alias(whole), F.col("cut").alias(cut))
    same = [x == F.col(k) for x, k in zip(leaf(docs, weights), keys, strict=True)]
    taken = (F.col(whole) > 0) | (_full_key(F.lit(0), docs["doc_id"].cast("bigint"), seed) <= F.col(cut))
    return docs.join(ends, [*same, taken], "left_semi")


def _sql_share(source: str, parent: str, order: str) -> str:
    return f"""SELECT *, CASE WHEN full_ THEN supply ELSE greatest(0.0, weight * max(CASE WHEN NOT full_ THEN level END) OVER (PARTITION BY {parent})) END AS budget FROM (
  SELECT *, supply <= weight * level AS full_ FROM (SELECT *, (parent_budget - (sum(supply) OVER o - supply)) / (sum(weight) OVER (PARTITION BY {parent}) - sum(weight) OVER o + weight) AS level
    FROM {source} WINDOW o AS (PARTITION BY {parent} ORDER BY supply / weight, supply, {order})))"""


def oracle_sql(share_of_all: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    weight = lambda col, table, other: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other}::DOUBLE END"
    names = list(DOMAINS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1) AS INTEGER), 0) % 3 AS k FROM documents),
t AS (SELECT doc_id, CASE k WHEN 0 THEN '{names[0]}' WHEN 1 THEN '{names[1]}' ELSE '{names[2]}' END AS domain, lang, source, n_tokens FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, (sum(n_tokens) * {epochs})::DOUBLE AS supply FROM t GROUP BY ALL),
lg AS (SELECT domain, lang, sum(supply) AS supply FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(supply) AS supply FROM lg GROUP BY ALL),
dw AS (SELECT *, 1 AS root, {weight('domain', DOMAINS, 0)} AS weight, floor(sum(supply) OVER () / {epochs} * {share_of_all}::DOUBLE)::DOUBLE AS parent_budget FROM dm),
ds AS ({_sql_share('dw', 'root', 'domain')}),
lw AS (SELECT lg.*, ds.budget AS parent_budget, {weight('lang', LANGUAGES, OTHER)} AS weight FROM lg JOIN ds USING (domain)),
ls AS ({_sql_share('lw', 'domain', 'domain, lang')}),
fw AS (SELECT leaf.*, ls.budget AS parent_budget, 1.0::DOUBLE AS weight FROM leaf JOIN ls USING (domain, lang)),
fs AS ({_sql_share('fw', 'domain, lang', 'domain, lang, source')}),
b AS (SELECT domain, lang, source, tokens, floor(budget + 1e-3)::BIGINT AS budget FROM fs),
e AS (SELECT t.*, b.budget - epoch * b.tokens AS rest, epoch, md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '?')) || lpad(coalesce(doc_id::VARCHAR, '?'), 20, '0') AS key
  FROM t JOIN b USING (domain, lang, source) CROSS JOIN (SELECT unnest(range({epochs})) AS epoch)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key) AS upto FROM e)
SELECT doc_id, epoch::INTEGER AS epoch, domain, lang, source, n_tokens FROM r WHERE upto <= rest
"""
