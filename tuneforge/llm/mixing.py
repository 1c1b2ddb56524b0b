"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the (domain, language, source) paths of a tree. A leaf's supply is the sum of its
documents' tokens, its cap the supply times ``max_epochs``; a node's cap is the sum below it. The
budget goes down the tree: the children of a node share its budget by their weights; a child
that cannot use its share keeps its cap and the shortage goes to its siblings, so an ancestor's
other branches get only what a whole branch cannot use. With caps sorted by cap / weight this
water-filling is a prefix sum over siblings; whole tokens are shared out exactly.

A leaf repeats its documents for each full epoch of its allocation and takes a token prefix of
the next epoch, whose order is an md5 of seed, epoch and doc_id. The prefix is found without
sorting a leaf: totals of hash ranges (``bucket_rows`` documents each) are summed along the
order, and only the one range of each leaf that holds the cut is sorted. The cut is a key of a
small table, so selection is a comparison in each row. DataFrame functions only.

Null and empty texts have no tokens and are never taken. Null path columns form a leaf of their
own, ``(none)``. Rows that repeat a doc_id tie and are taken or left together; a null doc_id is
ordered as an empty string. An empty table gives an empty result. Internal columns carry a
prefix, so columns of the input cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneforge.llm.common import small, text_or_empty, written

LEVELS = ["m_domain", "m_lang", "m_source"]
NONE = "(none)"

#: Production weights; what is not named weighs 1.
DOMAINS = 4
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo DOMAINS."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.concat(F.lit("domain"), F.pmod(number, F.lit(DOMAINS)).cast("string"))


def token_count() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaf_columns() -> list[Column]:
    """The path of a row, named LEVELS."""
    path = [domain_of(F.col("source").cast("string")), F.col("lang").cast("string"), F.col("source").cast("string")]
    return [F.coalesce(c, F.lit(NONE)).alias(name) for c, name in zip(path, LEVELS)]


def order_hash(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, F.lit(weight).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``alloc`` to nodes that have ``budget`` (of the parent), ``weight`` and ``cap``."""
    siblings = Window.partitionBy(*[F.col(p) for p in parent] or [F.lit(0)])
    order = [F.col("cap") / F.col("weight"), F.col(child)]
    ahead = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = siblings.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    full = F.col("cap") * F.sum("weight").over(onward) <= left * F.col("weight")
    marked = nodes.withColumn("full", full)
    rest = F.greatest(F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings), F.lit(0))
    open_weight = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(siblings)
    marked = marked.withColumn("rest", rest).withColumn("open_weight", open_weight)
    marked = marked.withColumn("floor", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("rest * weight div open_weight")))
    over = F.col("rest") - F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("floor"))).over(siblings)
    place = F.row_number().over(siblings.orderBy(F.col("full"), *order))
    extra = F.when(~F.col("full") & (place <= over), 1).otherwise(0)
    return marked.withColumn("alloc", (F.col("floor") + extra).cast("long")).drop("full", "rest", "open_weight", "floor", "budget")


def leaf_budgets(rows: DataFrame, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """LEVELS, supply, n_docs and alloc of each leaf. ``share``: the budget as a fraction of the supply."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    leaves = leaves.withColumn("cap", F.col("supply") * max_epochs)
    weights = [_weight(LEVELS[0], DOMAIN_WEIGHTS), _weight(LEVELS[1], LANG_WEIGHTS), F.lit(1).cast("long")]
    total = rows.agg(F.expr(f"coalesce(sum(tokens), 0) * {share[0]} div {share[1]}").alias("budget"))
    above, parent = total, []
    for depth, weight in enumerate(weights):
        own = LEVELS[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", weight)
        nodes = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above))
        above = share_out(nodes, parent, own[-1]).select(*own, F.col("alloc").alias("budget"))
        parent = own
    return leaves.join(above.withColumnRenamed("budget", "alloc"), LEVELS).drop("cap")


def leaf_cuts(rows: DataFrame, budgets: DataFrame, seed: int, bucket_rows: int = 1000) -> DataFrame:
    """Budgets with ``epochs`` (full ones) and the cut of the next: its last key and the tokens
    taken of that document. rows: LEVELS, doc_id, tokens."""
    budgets = budgets.withColumn("epochs", F.when(F.col("supply") > 0, F.expr("alloc div supply")).otherwise(0).cast("int"))
    budgets = written(budgets.withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("supply")))
    keyed = rows.where("tokens > 0").join(small(budgets.where("rest > 0")), LEVELS).withColumn("m_order", order_hash(F.col("epochs") + 1, seed))
    unit = F.conv(F.substring("m_order", 1, 8), 16, 10).cast("long")
    n_buckets = F.ceil(F.col("n_docs") / bucket_rows)
    keyed = keyed.withColumn("m_bucket", F.floor(unit * n_buckets / F.lit(2.0**32)).cast("long"))
    along = Window.partitionBy(*LEVELS).orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*LEVELS, "m_bucket", "rest").agg(F.sum("tokens").alias("total"))
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(along), F.lit(0)))
    edge = totals.where("before < rest and before + total >= rest").select(*LEVELS, "m_bucket", "before")
    tied = keyed.join(small(written(edge)), [*LEVELS, "m_bucket"]).groupBy(*LEVELS, "rest", "before", "m_order", "doc_id").agg(F.sum("tokens").alias("tokens"))
    inside = Window.partitionBy(*LEVELS).orderBy("m_order", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    cut = tied.withColumn("start", start).where("start < rest and start + tokens >= rest")
    cut = cut.select(*LEVELS, F.struct(F.col("m_order").alias("o"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d")).alias("cut"), (F.col("rest") - F.col("start")).alias("cut_take"))
    return written(budgets.join(cut, LEVELS, "left"))


def _key(seed: int) -> Column:
    return F.struct(order_hash(F.col("epochs") + 1, seed).alias("o"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"))


def plan(docs: DataFrame, share: tuple[int, int], max_epochs: int, seed: int, bucket_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (LEVELS, doc_id, tokens) and the leaf table with budgets and cuts."""
    rows = written(docs.select(*leaf_columns(), F.col("doc_id").cast("long").alias("doc_id"), token_count().alias("tokens")))
    return rows, leaf_cuts(rows, leaf_budgets(rows, share, max_epochs), seed, bucket_rows)


def selection(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """LEVELS, doc_id, tokens, epoch (from 1) and take: a row for each taken document and epoch."""
    joined = rows.where("tokens > 0").join(small(leaves), LEVELS).withColumn("key", _key(seed))
    partly = F.when(F.col("key") == F.col("cut"), F.least("tokens", "cut_take")).when(F.col("key") < F.col("cut"), F.col("tokens"))
    epochs = F.filter(F.sequence(F.lit(1), F.col("epochs") + 1), lambda e: (e <= F.col("epochs")) | F.col("partly").isNotNull())
    taken = joined.withColumn("partly", partly).withColumn("epoch", F.explode(epochs))
    take = F.when(F.col("epoch") <= F.col("epochs"), F.col("tokens")).otherwise(F.col("partly"))
    return taken.select(*LEVELS, "doc_id", "tokens", "epoch", take.alias("take"))


def mixed(docs: DataFrame, share: tuple[int, int], seed: int) -> DataFrame:
    """Documents of a mix of one epoch at most, each whole, with all columns of ``docs``."""
    _, leaves = plan(docs, share, 1, seed)
    leaves = leaves.select(*LEVELS, "epochs", "cut")
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *leaf_columns(), token_count().alias("tokens"))
    joined = named.join(small(leaves), LEVELS).where((F.col("tokens") > 0) & ((F.col("epochs") > 0) | (_key(seed) <= F.col("cut"))))
    return joined.select("row.*")
