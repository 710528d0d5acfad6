"""Mixing sources to target weights: hierarchical budgets, then a token prefix of each leaf's seeded epochs.

The tree is domain, language, source. A node's budget goes to its children by weight; a child
whose tokens (times the epochs allowed) fall short takes what it has, and its siblings share
the rest by weight; only what the whole node lacks reaches the node's own siblings. That is
water-filling from the root down with the capacities of whole subtrees. Weights are integers
and all sums are exact.

A leaf's budget buys full epochs and a prefix of one more, in an order drawn from the seed and
the epoch. The prefix ends in one hash bucket of about BUCKET rows, found by sums of runs of RUN
buckets and then of the buckets of one run; only that bucket's rows are
ordered, so a leaf with a third of all rows, or the sums of its buckets, never meet in one task.

Null languages and sources form nodes of their own, called "unknown". Null and empty texts have
0 tokens and never exceed a budget. Rows with the same doc_id, or without one, are separate rows that share
a place in the order; those with equal tokens are interchangeable. An empty table gives an empty
result. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from driftwell.llm.common import Scratch, table

BUCKET = 256
RUN = 4096  # buckets
LEVELS = ("mix_domain", "mix_lang", "mix_source")


@dataclass(frozen=True)
class Plan:
    """Integer weights by node name (others: 1), the share of all tokens to spend, epochs at most, seed."""

    domains: dict = field(default_factory=lambda: {"web": 5, "reference": 3, "community": 2})
    langs: dict = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2})
    sources: dict = field(default_factory=lambda: {"src1": 3, "src2": 2})
    percent: int = 80
    epochs: int = 2
    seed: int = 11


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def domain(source: Column) -> Column:
    """src0 is the web crawl, src1 to src9 are reference works, all others community sites."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "reference").otherwise("community")


def _weight(column: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(38,0)")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Water-filling of column ``budget`` among siblings with ``weight`` and ``capacity``; gives ``given``.

    In order of capacity for each unit of weight, the children that fill up come first. The first
    that stays open sees what all open ones share: the budget and the weights from itself on.
    """
    big = "decimal(38,0)"
    siblings = W.partitionBy(*parents)
    order = siblings.orderBy(F.expr("try_divide(cast(capacity as double), cast(weight as double))").asc_nulls_last(), name)
    spent = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(big))
    rows = nodes.withColumns({"_left": (F.col("budget") - spent).cast(big), "_weights": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).cast(big)})
    rows = rows.withColumn("_full", F.col("capacity") * F.col("_weights") <= F.col("weight") * F.col("_left"))
    first = {c: F.max(F.when(~F.col("_full"), F.col(c))).over(siblings).cast("decimal(20,0)") for c in ("_left", "_weights")}
    rows = rows.withColumns({"_open_left": first["_left"], "_open_weights": first["_weights"], "_weight": F.col("weight").cast("decimal(18,0)")})
    share = F.expr("coalesce(_weight * _open_left div nullif(_open_weights, 0), 0)").cast(big)
    rows = rows.withColumn("given", F.when(F.col("_full"), F.col("capacity")).otherwise(share).cast(big))
    return rows.drop("_left", "_weights", "_full", "_open_left", "_open_weights", "_weight")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """For leaves (LEVELS, rows, tokens): budget, and from it full epochs and the rest."""
    big = "decimal(20,0)"
    nodes = leaves.withColumn("capacity", (F.col("tokens") * plan.epochs).cast(big))
    one = lambda cols: nodes.groupBy(*cols).agg(F.sum("capacity").cast(big).alias("capacity"))
    whole = leaves.agg(F.expr(f"sum(tokens) * {plan.percent} div 100").cast(big).alias("budget"))
    top = one(LEVELS[:1]).withColumn("weight", _weight(LEVELS[0], plan.domains)).crossJoin(F.broadcast(whole))  # one row
    top = _fill(top.withColumn("all", F.lit(1)), ["all"], LEVELS[0]).select(LEVELS[0], F.col("given").alias("budget"))
    mid = one(LEVELS[:2]).join(top, LEVELS[0]).withColumn("weight", _weight(LEVELS[1], plan.langs))
    mid = _fill(mid, [LEVELS[0]], LEVELS[1]).select(*LEVELS[:2], F.col("given").alias("budget"))
    low = nodes.join(mid, list(LEVELS[:2])).withColumn("weight", _weight(LEVELS[2], plan.sources))
    low = _fill(low, list(LEVELS[:2]), LEVELS[2]).withColumn("budget", F.col("given").cast("long"))
    has = F.col("tokens") > 0
    return low.select(
        *LEVELS, F.greatest(F.expr(f"rows div {BUCKET}") + 1, F.lit(1)).alias("n_buckets"), "budget",
        F.when(has, F.expr("budget div nullif(tokens, 0)")).otherwise(0).cast("long").alias("full_epochs"),
        F.when(has, F.expr("budget % nullif(tokens, 0)")).otherwise(0).cast("long").alias("rest"),
    )


def _ordered(rows: DataFrame, plan: Plan) -> DataFrame:
    """mix_key: the row's place in the leaf's next epoch; mix_bucket: the part of the key's range it falls in."""
    key = F.md5(F.concat_ws("|", F.lit(plan.seed), (F.col("full_epochs") + 1).cast("string"), F.col("doc_id").cast("string")))
    return rows.withColumn("mix_key", key).withColumn("mix_bucket", F.expr("cast(conv(substr(mix_key, 1, 8), 16, 10) as bigint) * n_buckets div 4294967296"))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, the tokens and the leaf of each row, and the whole row as one column, so that no name can clash."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    return docs.select(
        F.struct("*").alias("row"), "doc_id", tokens(F.col("text")).alias("mix_tokens"),
        domain(source).alias(LEVELS[0]), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias(LEVELS[1]), source.alias(LEVELS[2]),
    )


def _first_beyond(sums: DataFrame, part: str, limit: str) -> DataFrame:
    """For each leaf the first part whose running sum of ``held`` exceeds the limit, and what is left of the limit where it begins."""
    upto = F.sum("held").over(W.partitionBy(*LEVELS).orderBy(part))
    beyond = sums.withColumn("upto", upto).filter(F.col("upto") > F.col(limit)).withColumn("left", F.col(limit) - (F.col("upto") - F.col("held")))
    return beyond.groupBy(*LEVELS).agg(F.min_by(F.struct(part, "left"), part).alias("first")).select(*LEVELS, "first.*")


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """row (all columns of ``docs``), mix_domain, mix_lang, mix_source, mix_tokens, and mix_copies: times the row is drawn, from 0."""
    with Scratch(docs.sparkSession) as scratch:
        slim = scratch.write(_labelled(docs).select("doc_id", "mix_tokens", *LEVELS), "mix-rows")
        leaves = slim.groupBy(*LEVELS).agg(F.count("*").alias("rows"), F.sum("mix_tokens").alias("tokens"))
        shares = scratch.write(budgets(leaves, plan).coalesce(1), "mix-budgets")
        keyed = _ordered(slim.join(shares, list(LEVELS)), plan)
        buckets = scratch.write(keyed.groupBy(*LEVELS, "rest", "mix_bucket").agg(F.sum("mix_tokens").alias("held")), "mix-buckets")
        runs = _first_beyond(buckets.groupBy(*LEVELS, "rest", F.expr(f"mix_bucket div {RUN}").alias("run")).agg(F.sum("held").alias("held")), "run", "rest")
        inside = buckets.join(F.broadcast(runs.select(*LEVELS, "run", "left")), list(LEVELS)).filter(F.expr(f"mix_bucket div {RUN} = run"))  # one row for each leaf
        ends = _first_beyond(inside, "mix_bucket", "left").select(*LEVELS, F.struct("mix_bucket", F.col("left").alias("inside")).alias("end"))
        ends = scratch.write(shares.join(ends, list(LEVELS), "left").coalesce(1), "mix-ends", read_later=True)
    rows = _ordered(_labelled(docs).join(ends, list(LEVELS)), plan)
    at_end = F.coalesce(F.col("mix_bucket") == F.col("end.mix_bucket"), F.lit(False))
    before = F.when(F.col("end").isNull(), F.col("rest") > 0).otherwise(F.col("mix_bucket") < F.col("end.mix_bucket"))
    clear = rows.filter(~at_end).withColumn("drawn", before)
    run = F.sum("mix_tokens").over(W.partitionBy(*LEVELS).orderBy("mix_key", "mix_tokens").rowsBetween(W.unboundedPreceding, 0))
    edge = rows.filter(at_end).withColumn("upto", run).withColumn("drawn", F.col("upto") <= F.col("end.inside")).drop("upto")
    both = clear.unionByName(edge)
    return both.select("row", *LEVELS, "mix_tokens", (F.col("full_epochs") + F.coalesce(F.col("drawn"), F.lit(False)).cast("long")).alias("mix_copies"))


def drawn(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows drawn, each as often as the mix draws it, in the columns of ``docs``."""
    return mix(docs, plan).filter("mix_copies > 0").select("row", F.explode(F.expr("sequence(1L, mix_copies)")).alias("epoch")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("row.doc_id", F.col("mix_domain").alias("domain"), "row.lang", "row.source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def _case(column: str, weights: dict) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{n}' THEN {w}" for n, w in sorted(weights.items())) + " ELSE 1 END::HUGEINT"


def _level(name: str, nodes: str, parents: str, key: str) -> str:
    """CTEs that fill ``nodes`` (keys, capacity, weight, budget) by the same rule."""
    by, order = f"PARTITION BY {parents}", f"PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {key}"
    return f"""
    {name}_1 AS (SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {nodes}),
    {name}_2 AS (SELECT *, capacity * weights <= weight * before AS is_full FROM {name}_1),
    {name}_3 AS (SELECT *, max(CASE WHEN NOT is_full THEN before END) OVER ({by}) AS rest_b, max(CASE WHEN NOT is_full THEN weights END) OVER ({by}) AS rest_w FROM {name}_2),
    {name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE weight * rest_b // rest_w END AS given FROM {name}_3)"""


def _sql(plan: Plan = Plan()) -> str:
    return f"""
    WITH rows_ AS (SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'reference' ELSE 'community' END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+'))::BIGINT AS n_tokens FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {plan.epochs} AS capacity FROM rows_ GROUP BY ALL),
    n1 AS (SELECT 1 AS one, domain, sum(capacity)::HUGEINT AS capacity, {_case("domain", plan.domains)} AS weight, (SELECT sum(tokens)::HUGEINT * {plan.percent} // 100 FROM leaf) AS budget FROM leaf GROUP BY domain),
    {_level("f1", "n1", "one", "domain")},
    n2 AS (SELECT leaf.domain, lang, sum(leaf.capacity)::HUGEINT AS capacity, {_case("lang", plan.langs)} AS weight, any_value(f1.given) AS budget FROM leaf JOIN f1 USING (domain) GROUP BY leaf.domain, lang),
    {_level("f2", "n2", "domain", "lang")},
    n3 AS (SELECT leaf.domain, leaf.lang, source, tokens, leaf.capacity, {_case("source", plan.sources)} AS weight, f2.given AS budget FROM leaf JOIN f2 ON leaf.domain = f2.domain AND leaf.lang = f2.lang),
    {_level("f3", "n3", "domain, lang", "source")},
    k AS (SELECT r.*, f3.given // nullif(tokens, 0) AS full_epochs, f3.given % nullif(tokens, 0) AS rest FROM rows_ r JOIN f3 USING (domain, lang, source)),
    s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{plan.seed}|' || (full_epochs + 1)::VARCHAR || '|' || doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
    SELECT doc_id, domain, lang, source, n_tokens, (full_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM s"""


SQL = _sql()
