"""A selection in which each source has its target share of all tokens.

Hierarchical budgeting: the total is divided down a tree of any levels (by default source, language, domain)
by the weights of its nodes: targets at the first level, below it the weights given for a level, or as many
tokens as a node has. A node that cannot use its budget, as its documents repeated as often as
allowed don't have the tokens, leaves the rest to its siblings by their weights, and only what they cannot
use goes to the siblings of its ancestors. The source is the first level because its share is what is
asked for. Each leaf takes whole epochs of its documents and of one more epoch, in an
order seeded by its number, the prefix that its budget reaches into. The document at which a prefix ends belongs to it
in part: of these documents a systematic sample by size is taken below each parent, so that rounding
doesn't add up over many small leaves.

Budgets are SQL over one row a node. The order is a hash; cumulative tokens are taken over ranges of
hashes, summed before they are shuffled, and only the range in which a leaf's budget ends is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.scratch import written
from pagewright.functions.skew import split_join
from pagewright.functions.tables import once

LEVELS = ("source", "lang", "domain")
#: Rows of a leaf in one range of hashes, about; at most RANGES ranges a leaf.
RANGE_ROWS, RANGES = 5_000, 1 << 20
_SPACE = 1 << 40
#: Leaves that are broadcast at most; beyond it documents meet their leaves by a shuffle that splits large leaves.
BROADCAST_LEAVES = 200_000


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, words joined by an underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def language(c: Column) -> Column:
    """A language code in lower case; und for null and anything else."""
    code = F.lower(F.trim(c))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.lit("und"))


def domain(c: Column) -> Column:
    """A site's name in lower case without www; none for null and blank ones."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")
    return F.when(name != "", name).otherwise(F.lit("none"))


def share_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Rows with the columns `parent`, name, room, weight and parent_budget -> the same with budget: the parent's
    budget by weight, none above its room. Children are filled in the order of room to weight; the level at which the
    others stand is where the budget ends. A child without weight gets what its siblings can't use, by its room."""
    weight = F.greatest(F.col("weight").cast("double"), F.col("room") * 1e-12)
    c = children.where("room > 0").withColumn("_w", weight).withColumn("_ratio", F.col("room") / F.col("_w"))
    group = list(parent) or [F.lit(0)]
    upto = Window.partitionBy(*group).orderBy("_ratio", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*group)
    c = c.withColumn("_rooms", F.sum("room").over(upto)).withColumn("_left", F.sum("_w").over(every) - F.sum("_w").over(upto)).withColumn("_have", F.least("parent_budget", F.sum("room").over(every)))
    c = c.withColumn("_full", F.col("_rooms") + F.col("_ratio") * F.greatest(F.col("_left"), F.lit(0.0)) <= F.col("_have") * (1 + 1e-12))
    taken, weights = F.sum(F.when(F.col("_full"), F.col("room")).otherwise(0.0)).over(every), F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
    budget = F.when(F.col("_full"), F.col("room")).otherwise(F.least(F.col("room"), (F.col("_have") - taken) * F.col("_w") / weights))
    return c.withColumn("budget", F.greatest(budget, F.lit(0.0))).drop("_w", "_ratio", "_rooms", "_left", "_have", "_full")


def budgets(leaves: DataFrame, targets: DataFrame, total: float | None, weights: dict[str, DataFrame] | None = None, levels: Sequence[str] = LEVELS) -> DataFrame:
    """leaves: a column for each level and tokens; targets: the first level, target_share, max_repeats; weights: for a
    level below the first, its value and weight -> leaves with tokens, max_repeats and budget."""
    goal = targets.groupBy(levels[0]).agg(F.sum("target_share").alias("weight"), F.max("max_repeats").alias("max_repeats")).where(F.col(levels[0]).isNotNull())
    sized = leaves.join(F.broadcast(goal), levels[0]).withColumn("room", (F.col("tokens") * F.col("max_repeats")).cast("double"))  # targets are a small table
    above = None
    for depth in range(1, len(levels) + 1):
        path, name = list(levels[:depth]), levels[depth - 1]
        nodes = sized.groupBy(*path).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"), F.first("weight").alias("target"), F.first("max_repeats").alias("max_repeats"))
        if depth == 1:
            if total is None:
                total = leaves.agg(F.sum("tokens")).first()[0] or 0
            nodes = nodes.withColumn("weight", F.col("target")).withColumn("parent_budget", F.lit(float(total)))
        else:
            nodes = nodes.withColumn("weight", F.col("tokens"))
            if weights and name in weights:
                given = weights[name].select(F.col(name), F.col("weight").alias("_given"))
                nodes = nodes.join(given, name, "left").withColumn("weight", F.coalesce("_given", F.lit(0.0))).drop("_given")
            nodes = nodes.join(above, path[:-1])
        above = share_out(nodes.withColumn("name", F.col(name)), path[:-1]).select(*path, F.col("budget").alias("parent_budget"), "tokens", "max_repeats", "room")
        last, above = above, above.select(*path, "parent_budget")
    return last.select(*levels, "tokens", "max_repeats", F.col("parent_budget").alias("budget"))


def _joined(docs: DataFrame, leaves: DataFrame, leaf: list[str], how: str = "inner") -> DataFrame:
    if leaves.count() <= BROADCAST_LEAVES:
        return docs.join(F.broadcast(leaves), leaf, how)
    return split_join(docs, leaves, leaf, ["doc_id"]) if how == "inner" else docs.join(leaves, leaf, how)


def select(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 3, weights: dict[str, DataFrame] | None = None, levels: Sequence[str] = LEVELS) -> DataFrame:
    """doc_id, n_tokens and a column for each level; targets: source, target_share, max_repeats -> doc_id, the levels,
    n_tokens, times: how often a document is used (those with 0 are left out). For language and domain, lang and site are read if
    there are no columns of those names; a level without a column is one node.

    total: tokens to select; by default as many as all documents have. Documents whose source is null or no target are
    never used, nor are those without tokens; spellings of a source are one source; a doc_id that is repeated counts as
    often as it is there."""
    leaf = list(levels)
    of = {"source": source_name, "lang": language, "domain": domain}
    have = {"domain": "site"} if "domain" not in sized.columns and "site" in sized.columns else {}
    columns = [(of.get(x, lambda c: c)(F.col(have.get(x, x))) if have.get(x, x) in sized.columns else F.lit("none")).alias(x) for x in leaf]
    docs = sized.where("n_tokens > 0").select("doc_id", *columns, "n_tokens")
    sums = written(docs.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    plan = budgets(sums, named, total, weights, levels).join(sums.select(*leaf, "docs"), leaf)
    epochs = F.floor(F.col("budget") / F.col("tokens") + 1e-9)
    plan = plan.where("budget > 0").withColumn("epochs", epochs.cast("int")).withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("tokens"), F.lit(0.0)))
    ranges = F.least(F.lit(RANGES), F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_ROWS))).cast("int")
    plan = written(plan.select(*leaf, "epochs", "rest", ranges.alias("ranges")), "plan")
    docs = _joined(docs, plan, leaf)
    place = F.pmod(F.xxhash64(F.lit(seed), "epochs", "doc_id"), F.lit(_SPACE))
    docs = docs.withColumn("place", place).withColumn("range", F.floor(F.col("place") * F.col("ranges") / _SPACE).cast("int"))
    step = docs.groupBy(*leaf, "range", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = step.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("range")))
    ends = upto.where("upto > rest").groupBy(*leaf).agg(F.min_by(F.struct("range", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")), "range").alias("end"))
    docs = _joined(docs, written(ends, "ends"), leaf, "left")
    within = docs.where("end is null or range < end.range").withColumn("in", F.lit(1))
    after = docs.where("range > end.range").withColumn("in", F.lit(0))
    w = Window.partitionBy(*leaf).orderBy("place", "doc_id")
    at_end = docs.where("range = end.range").withColumn("upto", F.sum("n_tokens").over(w))
    part = (F.col("end.room") - F.col("upto") + F.col("n_tokens")) / F.col("n_tokens")
    at_end = written(at_end.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))).drop("upto"), "at_end")
    whole = at_end.where("part = 0 or part = 1").withColumn("in", F.col("part").cast("int")).drop("part")
    parent = leaf[:-1] or [F.lit(0)]
    v = Window.partitionBy(*parent).orderBy("n_tokens", "doc_id")  # a document a leaf
    cut = at_end.where("part > 0 and part < 1").withColumn("upto", F.sum("part").over(v) + 0.5)
    cut = cut.withColumn("in", (F.floor("upto") > F.floor(F.col("upto") - F.col("part"))).cast("int")).drop("upto", "part")
    out = within.unionByName(whole).unionByName(cut).unionByName(after).withColumn("times", F.col("epochs") + F.when(F.col("rest") > 0, F.col("in")).otherwise(0))
    return out.where("times > 0").select("doc_id", *leaf, "n_tokens", "times")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, docs, tokens, share, most_times for every target; a source without documents has 0; of an empty selection the shares
    are null."""
    got = selected.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").join(F.broadcast(got), "source", "left").fillna(0, ["docs", "tokens", "most_times"])
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over the targets, which are few
    return t.select("source", "target_share", "max_repeats", "docs", "tokens", F.try_divide("tokens", every).alias("share"), "most_times")


def level_shares(selected: DataFrame, levels: Sequence[str] = LEVELS[:2]) -> DataFrame:
    """For every node with documents selected: the levels, docs, tokens, and its share of what its parent got."""
    got = selected.groupBy(*levels).agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"))
    w = Window.partitionBy(*(list(levels[:-1]) or [F.lit(0)]))
    return got.withColumn("share_of_parent", F.try_divide("tokens", F.sum("tokens").over(w)))


def selection(docs: DataFrame, targets: DataFrame, lengths, total: float | None = None, seed: int = 3) -> DataFrame:
    one = once(docs.select("doc_id", "text", "source", "lang", "site"), "doc_id")
    return select(written(lengths(one), "lengths"), targets, total, seed)
