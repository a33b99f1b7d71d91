"""Mixing sources to target weights with hierarchical budgets.

A token budget is handed down a tree domain - language - source. At each node it is split over the
children by weight; a child that can't take its share (its leaves' tokens times max_epochs) takes what it
can, and the shortage goes to its siblings by their weights. A node is never handed more than its whole
subtree can take, so a shortage reaches other branches only after all siblings are full. All arithmetic is on
whole tokens: what division leaves over goes one token each to the largest remainders, ties by name.

A leaf takes whole epochs of its documents and then a prefix of one more epoch, in the order of a seeded
hash of epoch and document. The prefix may end within a document. To find its end, tokens are summed by
leaf and hash bucket, and the bucket in which the prefix ends is cut into buckets again until it holds at most
EDGE_ROWS rows; only these are ordered row by row. (Rows of one key have one hash: they stay in one bucket.)

Everything is DataFrame functions. Defined results: null domain, language or source is the name ''; a
text's tokens are its words; null and empty texts have none and are taken with every epoch that reaches
them, as zero tokens. Rows that repeat are taken together or, in the bucket of the end, in hash order.
Weights must be whole and at most 10^4; a weight of 0 takes nothing. Extra columns stay in `mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.common import stored, unused

LEVELS = ("domain", "lang", "source")
#: Leaves up to which the plan is broadcast (some 200 bytes a leaf); more leaves are joined by shuffle.
BROADCAST_LEAVES = 20_000
#: Hash buckets of a leaf, or of a bucket, by so many hexadecimal digits; digits of a hash that are used at most.
BUCKET_DIGITS, MOST_DIGITS = 2, 30
#: Rows of the bucket in which a leaf's prefix ends, at most.
EDGE_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
#: After a word and before white space: between the pieces of which each holds one word.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


@dataclass(frozen=True)
class Mixture:
    """budget_parts / budget_whole of all tokens, at most max_epochs of each leaf; weights by level and name, 1 if absent."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    budget_parts: int = 1
    budget_whole: int = 1
    max_epochs: int = 2
    seed: str = "mix"


def domain_of_source(source: Column) -> Column:
    """Domains of the registered query: sources are dealt by the number at their name's end."""
    n = F.try_mod(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(3))
    return F.when(n == 0, "web").when(n == 1, "books").when(n == 2, "code").otherwise("other")


def _weight(mixture: Mixture, level: str) -> Column:
    out = F.lit(None)
    for name, weight in mixture.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return F.coalesce(out, F.lit(1)).cast("bigint")


#: Products of tokens and weights have up to 38 digits.
_PART, _OPEN = "CAST(weight AS DECIMAL(19, 0)) * CAST(left AS DECIMAL(19, 0))", "CAST(open_weight AS DECIMAL(19, 0))"


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def split_budget(nodes: DataFrame, parents: list[str], label: str) -> DataFrame:
    """nodes with `given`: its part of `budget` (its parent's), by `weight` and at most `cap`.

    Children in ascending order of cap / weight fill up first: one is full if the rest of the budget, by
    weight over it and those after it, is at least its cap.
    """
    over = Window.partitionBy(*[F.col(p) for p in parents]) if parents else Window.partitionBy(F.lit(0))
    order = over.orderBy(F.col("cap") / F.col("weight"), label)  # of doubles
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("full", _big(F.col("budget") - before) * _big(F.col("weight")) >= _big(F.col("cap")) * _big(onward))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(over)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(over)
    nodes = nodes.withColumns({"left": left, "open_weight": F.greatest(open_weight, F.lit(1))})
    nodes = nodes.withColumn("share", F.when(F.col("full"), F.lit(0)).otherwise(F.expr(f"{_PART} div {_OPEN}")).cast("bigint"))
    rest = F.when(F.col("full"), F.lit(-1)).otherwise(F.expr(f"{_PART} % {_OPEN}").cast("bigint"))
    nodes = nodes.withColumn("rest", rest)
    spare = F.col("left") - F.sum("share").over(over)
    place = F.row_number().over(over.orderBy(F.desc("rest"), label))
    nodes = nodes.withColumns({"spare": spare, "place": place})
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + F.when(F.col("place") <= F.col("spare"), 1).otherwise(0))
    return nodes.withColumn("given", given.cast("bigint")).drop("full", "left", "open_weight", "share", "rest", "spare", "place")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `given`, the tokens that each contributes."""
    tree = leaves.withColumn("cap", F.col("tokens") * mixture.max_epochs)
    for level in LEVELS:
        tree = tree.withColumn(f"w_{level}", _weight(mixture, level))
    tree = tree.filter(" AND ".join(f"w_{level} > 0" for level in LEVELS))
    total = leaves.agg(F.expr(f"CAST(coalesce(sum(tokens), 0) AS DECIMAL(28, 0)) * {mixture.budget_parts} div {mixture.budget_whole}").alias("wanted"))
    above = None
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{path[-1]}").alias("weight"))
        if above is None:
            whole = nodes.agg(F.sum("cap").alias("all_caps")).crossJoin(total).select(F.least("all_caps", "wanted").alias("budget"))
            nodes = nodes.crossJoin(F.broadcast(whole))  # one row
        else:
            nodes = nodes.join(above, path[:-1])
        above = split_budget(nodes, path[:-1], path[-1]).select(*path, F.col("given").alias("budget"))
    return leaves.join(above, list(LEVELS), "left").withColumn("given", F.coalesce("budget", F.lit(0)).cast("bigint")).drop("budget")


def _hash(mixture: Mixture, epoch: Column, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{mixture.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _bounded(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else plan


def _levels(domain: Column) -> dict[str, Column]:
    return {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}.items()}


def _tokens(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("bigint")


def sizes(docs: DataFrame, domain: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, lang, source, tokens, tie) of every document, stored: texts are read and their words counted once."""
    narrow = docs.select(F.col(key).alias("key"), *[v.alias(k) for k, v in _levels(domain).items()], _tokens(text).alias("tokens"), F.xxhash64(text).alias("tie"))
    return stored(narrow, "mix-sizes")


def plan_mixture(narrow: DataFrame, mixture: Mixture) -> DataFrame:
    """One row per leaf: its budget, whole epochs, and where the prefix of the next epoch ends. narrow: as of `sizes`.

    cut is the beginning of the hashes of the bucket in which that prefix ends, cut_tokens how many tokens of it are taken.
    """
    leaves = stored(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    plan = leaf_budgets(leaves, mixture)
    whole = F.when(F.col("tokens") > 0, F.expr("given div greatest(tokens, 1)")).otherwise(0).cast("int")
    plan = stored(plan.withColumn("epochs", whole).withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens")), "mix-plan")
    cuts = plan.filter("rest > 0").select(*LEVELS, "epochs", F.lit("").alias("cut"), F.col("rest").alias("cut_tokens"))
    for digits in range(BUCKET_DIGITS, MOST_DIGITS + 1, BUCKET_DIGITS):
        dealt = narrow.join(_bounded(cuts), list(LEVELS)).withColumn("order", _hash(mixture, F.col("epochs") + 1, "key"))
        dealt = dealt.filter(F.substring("order", 1, digits - BUCKET_DIGITS) == F.col("cut"))
        sums = dealt.groupBy(*LEVELS, "epochs", "cut_tokens", F.substring("order", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ends = sums.withColumn("upto", upto).filter("upto >= cut_tokens AND upto - n < cut_tokens")
        found = stored(ends.select(*LEVELS, "epochs", F.col("bucket").alias("cut"), F.expr("cut_tokens - upto + n").alias("cut_tokens"), "rows"), "mix-cuts")
        cuts = found.drop("rows")
        if (found.agg(F.max("rows")).first()[0] or 0) <= EDGE_ROWS:
            break
    return stored(plan.join(cuts.drop("epochs"), list(LEVELS), "left"), "mix-cuts")


def select_mixture(rows: DataFrame, plan: DataFrame, mixture: Mixture, levels: dict[str, Column], key: str, tokens: Column, tie: Column, own: str) -> DataFrame:
    """rows, one for each epoch that takes a row, with columns named own and domain, epoch, tokens, taken, part.

    part marks the row in which its leaf's prefix ends, of whose tokens only `taken` are; other rows are taken whole.
    """
    name = {c: f"{own}_{c}" for c in (*LEVELS, "epochs", "cut", "cut_tokens", "order", "tokens", "tie", "n", "epoch", "before", "taken", "part")}
    plan = plan.select(*[F.col(c).alias(name[c]) for c in (*LEVELS, "epochs", "cut", "cut_tokens")])
    base = rows.withColumns({name[k]: v for k, v in levels.items()} | {name["tokens"]: tokens, name["tie"]: tie}).join(_bounded(plan), [name[k] for k in LEVELS])
    col = {k: F.col(v) for k, v in name.items()}
    base = base.withColumn(name["order"], F.when(col["cut"].isNotNull(), _hash(mixture, col["epochs"] + 1, f"`{key}`")))
    columns = [F.col(f"`{c}`") for c in rows.columns] + [col[c] for c in ("domain", "epoch", "tokens", "taken", "part")]
    bucket = F.substring(col["order"], F.lit(1), F.char_length(col["cut"]))
    inside = col["epochs"] + F.when(bucket < col["cut"], 1).otherwise(0)
    whole = base.withColumn(name["n"], inside).filter(col["n"] > 0).withColumn(name["epoch"], F.explode(F.sequence(F.lit(1), col["n"])))
    whole = whole.withColumns({name["taken"]: col["tokens"], name["part"]: F.lit(False)}).select(*columns)
    order = Window.partitionBy(*[col[k] for k in LEVELS]).orderBy(col["order"], F.col(f"`{key}`"), col["tie"])
    before = F.coalesce(F.sum(col["tokens"]).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = base.filter(bucket == col["cut"]).withColumn(name["before"], before).filter(col["before"] < col["cut_tokens"])
    edge = edge.withColumn(name["taken"], F.least(col["tokens"], col["cut_tokens"] - col["before"]))
    edge = edge.withColumns({name["epoch"]: col["epochs"] + 1, name["part"]: col["taken"] < col["tokens"]}).select(*columns)
    return whole.unionByName(edge)


def first_words(text: Column, n: Column) -> Column:
    """The beginning of text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, WORD_END), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, mixture: Mixture, domain: Column, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mixture as documents with docs' columns: texts cut to the words taken, their lengths put right."""
    plan = plan_mixture(sizes(docs, domain, key, text), mixture)
    own = unused("mix", docs.columns)
    # Of rows that are taken whole the words aren't counted again: nothing below asks for them.
    found = select_mixture(docs, plan, mixture, _levels(domain), key, _tokens(text), F.xxhash64(F.col(f"`{text}`")), own)
    part = F.col(f"{own}_part")
    cut = {text: F.when(part, first_words(F.col(f"`{text}`"), F.col(f"{own}_taken"))).otherwise(F.col(f"`{text}`"))}
    if n_chars in docs.columns:
        cut[n_chars] = F.when(part, F.char_length(cut[text]).cast("bigint")).otherwise(F.col(f"`{n_chars}`"))
    return found.select(*[cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns])


def mixture_rows(docs: DataFrame, mixture: Mixture, domain: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, domain, lang, source, epoch, n_tokens, n_taken) of every document that an epoch takes; texts are read once."""
    narrow = sizes(docs, domain, key, text)
    levels = {k: F.col(k) for k in LEVELS}
    found = select_mixture(narrow, plan_mixture(narrow, mixture), mixture, levels, "key", F.col("tokens"), F.col("tie"), "_mix")
    return found.select(F.col("key").alias(key), *LEVELS, F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_taken").alias("n_taken"))
