"""Mixing sources to target weights: hierarchical budgets, and a token-prefix of seeded epochs for each leaf.

Documents belong to leaves of a tree (domain, language, source). A node's capacity is
the tokens below it times the number of epochs allowed, not counting leaves with a weight
of 0 on the way to them. The total budget goes down from the root: siblings share their parent's budget by weight; one whose capacity is less
than its share gets its capacity, and its siblings share the rest by their weights.
A node asks for no more than the capacity below it, so a leaf's shortage is made good
by its siblings first and reaches an ancestor's siblings only when all of them are full.
All of it is whole-number arithmetic over one row per node.

A leaf takes as many whole epochs as its budget holds, and of the next one the documents
in the order of a seeded digest until the budget is reached. The place of the cut is
found by descending the digest two hexadecimal digits at a time: each step sums tokens
by digit, so that no task sees more than 256 rows of a leaf, however large it is. What
is left then is a comparison of each document with its leaf's cut. A plan of up to
MOST_LEAVES leaves is broadcast, so texts aren't shuffled; of a larger one only the rows
of leaves with very many documents are, and the others meet theirs by a shuffle.
The digest is of the seed, the epoch, the id and the text, so only rows alike in id and
text share one; such rows at a leaf's cut are numbered, part by part, and take the rest
of the budget in that order.

Cases: a null in a level is the empty name; tokens are words, a null or blank text has
none and comes along where its digest lies before the cut; a leaf without tokens or with
weight 0 takes no part; rows that share an id, or have none, are ordered by their texts,
and rows alike in both have any order; an empty table gives an empty result. Every chosen row comes once for each
epoch, with all its columns; the added ones take the place of existing ones with their
names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm._io import hot_keys, looked_up, written

STEPS, DIGITS = 3, 2
MOST_LEAVES = 100_000  # of a plan that is broadcast: at most about 30 MB


def _weight(name: str, weights: dict[str, int], otherwise: int = 1) -> Column:
    out = F.lit(otherwise)
    for value, w in sorted(weights.items()):
        out = F.when(F.col(name) == value, w).otherwise(out)
    return out.cast("long")


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (capacity, weight, parent_budget) with budget: by weight, but no more than the capacity."""
    first = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    before, every = first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    full = F.col("capacity") * F.col("weight_left") <= F.col("weight") * F.col("budget_left")
    return (
        children.filter("weight > 0")
        .withColumn("budget_left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", full)
        .withColumn("budget_left", F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(every), F.lit(0)))
        .withColumn("weight_left", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(weight * budget_left) div weight_left")))
        .drop("budget_left", "weight_left", "full", "parent_budget")
    )


def budgets(sizes: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """sizes (levels..., tokens) with the budget of each leaf; the total is percent of all tokens."""
    live = reduce(lambda a, c: a & (_weight(c, weights.get(c, {})) > 0), levels, F.lit(True))
    sizes = sizes.withColumn("__live", F.when(live, F.col("tokens")).otherwise(0))
    parents = None
    for depth in range(1, len(levels) + 1):
        above, here = levels[: depth - 1], levels[:depth]
        nodes = sizes.groupBy(*here).agg((F.sum("__live") * max_epochs).alias("capacity"), F.sum("tokens").alias("__every")).withColumn("weight", _weight(here[-1], weights.get(here[-1], {})))
        if parents is None:  # the root's capacity is that of the nodes of the first level
            root = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumns({"__every": F.sum("__every").over(root), "__most": F.sum("capacity").over(root)})
            nodes = nodes.withColumn("parent_budget", F.least(F.expr(f"__every * {percent} div 100"), "__most")).drop("__most")
        else:
            nodes = nodes.join(parents.select(*above, F.col("budget").alias("parent_budget")), above)
        parents = _shared(nodes.drop("__every").filter("capacity > 0"), above or [F.lit(0)], here[-1])
    return sizes.drop("__live").join(parents.select(*levels, "budget"), levels)


def _met(rows: DataFrame, plan: DataFrame, key: list[str] | str, sizes: DataFrame, leaves: int) -> DataFrame:
    """rows with what plan says of their leaves (fewer than leaves): by a broadcast, or where that grows too large only for leaves with very many rows. sizes: rows of each leaf."""
    if leaves <= MOST_LEAVES:
        return rows.join(F.broadcast(plan), key)
    return looked_up(rows, plan, key, hot_keys(sizes, key, sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]))


def _cuts(slim: DataFrame, plan: DataFrame, levels: list[str], seed: int, sizes: DataFrame, leaves: int) -> DataFrame:
    """For each leaf with a part of an epoch: the digest at which it ends, the tokens before it, and how many rows have it."""
    open_ = _met(slim, plan.filter("rest > 0").select(*levels, "full_epochs", "rest"), levels, sizes, leaves).withColumn("key", _key(seed, "full_epochs"))
    at = plan.filter("rest > 0").select(*levels, F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for step in range(1, STEPS + 1):
        left = _met(open_, at, levels, sizes, leaves).filter(F.startswith("key", "prefix"))
        sums = left.groupBy(*levels, F.substring("key", 1, DIGITS * step).alias("digits")).agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        at = written(_hit(sums, levels, "digits").select(*levels, F.col("digits").alias("prefix"), F.col("start").alias("before")), "mix-cut")
    left = _met(open_, at, levels, sizes, leaves).filter(F.startswith("key", "prefix"))
    last = left.groupBy(*levels, "key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    return written(_hit(last, levels, "key").select(*levels, F.col("key").alias("cut_key"), F.col("start").alias("cut_start"), "copies"), "mix-cut")


def _hit(sums: DataFrame, levels: list[str], by: str) -> DataFrame:
    before = Window.partitionBy(*levels).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return placed.filter("start < rest and start + tokens >= rest")


def _key(seed: int, epoch: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(epoch), F.col("mix_id")).cast("binary"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], percent: int = 60, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs chosen to the weights: a row for each epoch of a document, with the levels, epoch, n_tokens and n_used.

    n_used is the part of a document within the budget; it is less than n_tokens only for
    the document at which a leaf's budget ends.
    """
    names = list(levels)
    held = {c: F.coalesce(x.cast("string"), F.lit("")) for c, x in levels.items()}
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own_id = F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    slim = written(docs.select(*(x.alias(c) for c, x in held.items()), own_id.alias("mix_id"), tokens.alias("n_tokens")), "mix-sizes")
    sizes = written(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    plan = budgets(sizes.drop("rows"), names, weights, percent, max_epochs)
    plan = written(plan.withColumn("full_epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens")), "mix-plan")
    leaves = plan.count()
    cuts = _cuts(slim, plan, names, seed, sizes, leaves)
    plan = written(plan.join(cuts, names, "left").select(*names, "full_epochs", "rest", "cut_key", "cut_start", "copies"), "mix-plan")

    leaf = [F.col(f"mix_{i}") for i in range(len(names))]
    rows = docs.withColumns({f"mix_{i}": x for i, x in enumerate(held.values())} | {"mix_id": own_id})
    rows = rows.withColumns({"n_tokens": tokens, **{c: x for c, x in zip(names, leaf, strict=True) if c not in docs.columns}})
    rows = rows.withColumn("mix_leaf", F.struct(*leaf)).drop(*(f"mix_{i}" for i in range(len(names))))
    own = F.struct(*(F.col(c).alias(f"mix_{i}") for i, c in enumerate(names)))
    plan = plan.select(own.alias("mix_leaf"), F.col("full_epochs").alias("mix_full"), F.col("rest").alias("mix_rest"), F.col("cut_key").alias("mix_cut"), F.col("cut_start").alias("mix_start"), F.col("copies").alias("mix_copies"))
    rows = _met(rows, plan, "mix_leaf", sizes.select(own.alias("mix_leaf"), "rows"), leaves).withColumn("mix_key", _key(seed, "mix_full"))
    at_cut = F.coalesce(F.col("mix_key") == F.col("mix_cut"), F.lit(False))
    if cuts.filter("copies > 1").isEmpty():
        rows = rows.withColumn("mix_before", F.lit(0).cast("long"))
    else:
        rows = _numbered(rows, at_cut & (F.col("mix_copies") > 1))
    left = F.col("mix_rest") - F.col("mix_start") - F.col("mix_before") * F.col("n_tokens")  # of the budget, when rows alike before this one are served
    epochs = F.col("mix_full") + F.when((F.col("mix_key") < F.col("mix_cut")) | at_cut & (left > 0), 1).otherwise(0)
    rows = rows.withColumn("mix_epochs", epochs).filter("mix_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_epochs") - 1)))
    last = (F.col("epoch") == F.col("mix_full")) & at_cut
    rows = rows.withColumn("n_used", F.when(last, F.least("n_tokens", left)).otherwise(F.col("n_tokens")))
    return rows.drop("mix_leaf", "mix_id", "mix_full", "mix_rest", "mix_cut", "mix_start", "mix_copies", "mix_key", "mix_before", "mix_epochs")


def _numbered(rows: DataFrame, alike: Column) -> DataFrame:
    """rows with mix_before: of those alike at a cut, how many come before one. They are counted by parts of a written table, so no task gathers them."""
    held = written(rows.filter(alike), "mix-copies").withColumn("mix_part", F.spark_partition_id())
    parts = written(held.groupBy("mix_leaf", "mix_part").agg(F.count("*").alias("mix_rows")), "mix-parts")
    before = F.sum("mix_rows").over(Window.partitionBy("mix_leaf").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("mix_leaf", "mix_part", F.coalesce(before, F.lit(0)).alias("mix_offset"))
    own = F.row_number().over(Window.partitionBy("mix_leaf", "mix_part").orderBy("mix_key")) - 1
    placed = held.withColumn("mix_before", own.cast("long")).join(offsets, ["mix_leaf", "mix_part"])
    placed = placed.withColumn("mix_before", F.col("mix_before") + F.col("mix_offset")).drop("mix_part", "mix_offset")
    return rows.filter(~alike).withColumn("mix_before", F.lit(0).cast("long")).unionByName(placed)


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, for n from 1 to less than its number of words; white space between words stays."""
    spaces = F.lit(" \t\n\x0b\x0c\r")
    behind = F.get(F.split(F.ltrim(text, spaces), r"[\x20\x09-\x0D]+", (n + 1).cast("int")), n.cast("int"))
    return F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(behind)), spaces)


def domain(source: str = "source") -> Column:
    """The domain of a source of the test tables: its number modulo 4; none without a number."""
    return F.expr(f"concat('d', try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint) % 4)")


#: Production parameters.
WEIGHTS = {"domain": {"d0": 2, "d1": 3, "d2": 3, "d3": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
PERCENT, MAX_EPOCHS, SEED = 60, 3, 17


def _sql() -> str:
    def weight(name: str, weights: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"

    def share(name: str, parent: list[str], above: str, weights: dict[str, int]) -> str:
        here = [*parent, name]
        w = weight(name, weights)
        by, keys, on = ", ".join(parent) or "1", ", ".join(here), " AND ".join(f"c.{p} = p.{p}" for p in parent) or "true"
        return f"""
{name}_1 AS (SELECT c.*, p.budget AS pb FROM (SELECT {keys}, sum(tokens) * {MAX_EPOCHS} AS cap, CAST({w} AS HUGEINT) AS w FROM sizes WHERE tokens > 0 AND {live} GROUP BY {keys}) c JOIN {above} p ON {on}),
{name}_2 AS (SELECT *, pb - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bl,
  sum(w) OVER (PARTITION BY {by}) - coalesce(sum(w) OVER (PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl FROM {name}_1),
{name}_3 AS (SELECT *, cap * wl <= w * bl AS isfull FROM {name}_2),
{name}_n AS (SELECT {keys}, CASE WHEN isfull THEN cap ELSE (w * (pb - coalesce(sum(CASE WHEN isfull THEN cap END) OVER (PARTITION BY {by}), 0))) // sum(CASE WHEN NOT isfull THEN w END) OVER (PARTITION BY {by}) END AS budget FROM {name}_3),"""

    levels = ["domain", "lang", "source"]
    live = " AND ".join(f"{weight(c, WEIGHTS.get(c, {}))} > 0" for c in levels)
    shares = "".join(share(c, levels[:i], f"{levels[i - 1]}_n" if i else "root", WEIGHTS.get(c, {})) for i, c in enumerate(levels))
    return f"""
WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS tie, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR), '') AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS HUGEINT) AS n FROM documents),
sizes AS (SELECT domain, lang, source, sum(n) AS tokens FROM t GROUP BY ALL),
root AS (SELECT least(coalesce(sum(tokens), 0) * {PERCENT} // 100, coalesce(sum(tokens) FILTER ({live}), 0) * {MAX_EPOCHS}) AS budget FROM sizes),{shares}
plan AS (SELECT domain, lang, source, budget // tokens AS full_epochs, budget % tokens AS rest FROM sizes JOIN source_n USING (domain, lang, source)),
k AS (SELECT t.*, full_epochs, rest, md5(concat_ws('|', '{SEED}', CAST(full_epochs AS VARCHAR), CAST(doc_id AS VARCHAR), tie)) AS key FROM t JOIN plan USING (domain, lang, source)),
s AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, n AS own FROM k),
e AS (SELECT *, unnest(range(0, CAST(full_epochs + CASE WHEN upto - own < rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM s)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens,
  CAST(CASE WHEN epoch = full_epochs AND upto >= rest THEN least(n, rest - (upto - own)) ELSE n END AS BIGINT) AS n_used FROM e"""


SQL = _sql()
