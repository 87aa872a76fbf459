"""Mixing sources to target weights.

The tree is domain - language - source. A token budget is handed down from the root: each
node gets its weight's share among its siblings, bounded by what its documents can give,
which is ``max_epochs`` times their tokens. What a node cannot use goes to its siblings in
proportion to their weights, as often as needed; only what all siblings together cannot
use is handed back to the parent and so to the parent's siblings. Handing down exactly
what a subtree can hold does both at once: a node's capacity is the sum of its leaves'.

A leaf (one source in one language) takes whole epochs first and then a prefix of the next
one. An epoch is an order of the leaf's documents by a seeded digest of their ids, another
order for each epoch; the prefix ends with the document that reaches the budget. Every
document is hence taken ``floor`` or ``ceil`` of budget / tokens times. Rows with one id are
ordered by a hash of the whole row, and so are rows without an id; of rows equal in all
columns as many are taken as the budget needs.

The prefix is found without putting a leaf in one task: the digests' range is cut into
``SLICES`` slices, token sums per slice give the slice where the budget is reached, and
only that slice is looked at again, by digest, then by slices of the rows' hashes, then by
hash. Each look adds up equal values before they are moved, so an id or a row that makes up
a third of a leaf is one value. The leaves' cut points, one row per leaf, are then joined
to the documents, whose texts are not shuffled.

Tokens are counted in words (runs without white space) plus one for the end, so an empty
text counts one. Nulls: a null text counts one; null languages or sources are leaves of
their own, with default weights. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffline.session import staged

SLICES = 1024
DIGEST_BITS = 60
LEVELS = ("_domain", "_lang", "_source")


def content(docs: DataFrame) -> Column:
    """A hash of the whole row, below 2**60 (but for maps and variants, which have none)."""
    plain = [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), 64 - DIGEST_BITS)


def digest(key: Column, row: Column, epoch: int, seed: int) -> Column:
    """A place in the epoch's order, below 2**60."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("row "), row.cast("string")))
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), own)
    return F.conv(F.substring(F.md5(text), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def n_tokens(text: Column) -> Column:
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    squeezed = F.regexp_replace(spaced, " {2,}", " ")
    return F.when(squeezed == "", 1).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 2).cast("long")


def _weights(level: str, given: dict[str | None, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in given.items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(out)
    return out


def _handed_down(nodes: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """``nodes``: columns of the tree, ``capacity`` and ``grant`` of the parent. Adds each
    node's ``share`` of the grant: proportional to weight, never above capacity.

    Siblings are filled in the order of capacity / weight: with level x, a node takes
    min(capacity, weight * x); x follows from sums over the siblings, exactly."""
    by_parent = Window.partitionBy(*parent)
    n = nodes.withColumn("w", F.greatest(weight, F.lit(0.0)))
    # Siblings without weight are used only if the others cannot take the grant.
    n = n.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1e-12)))
    # In order of fill level: before a node is full, the full ones give their capacity.
    n = n.withColumn("level", F.col("capacity") / F.col("w"))
    order = by_parent.orderBy("level", *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    n = n.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The first node that stays open fixes the level for all from it on.
    stays = (F.col("grant") - F.col("full")) < F.col("level") * F.col("open_w")
    n = n.withColumn("nth", F.row_number().over(order))
    at = F.struct(F.col("nth"), ((F.col("grant") - F.col("full")) / F.col("open_w")).alias("x"))
    n = n.withColumn("x", F.min(F.when(stays, at)).over(by_parent).getField("x"))
    n = n.withColumn("share", F.when(F.col("x").isNull(), F.col("capacity").cast("double")).otherwise(
        F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("w") * F.col("x")))))
    return n.drop("w", "level", "full", "open_w", "nth", "x")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str | None, float]], max_epochs: int) -> DataFrame:
    """``leaves``: the tree's columns and ``tokens``. Adds ``budget``, whole tokens."""
    sized = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    # One row: the grant of the root.
    root = sized.agg(F.sum("capacity").alias("all"), F.sum("tokens").alias("tokens"))
    grant = root.select(F.least(F.col("all").cast("double"), budget.cast("double")).alias("grant")).first().grant
    down = None
    for depth in range(len(LEVELS)):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = sized.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        if down is None:
            nodes = nodes.withColumn("grant", F.lit(grant).cast("double"))
        else:
            nodes = nodes.join(down, [F.col(k).eqNullSafe(F.col(f"up{k}")) for k in parent]).select(*keys, "capacity", "grant")
        shared = _handed_down(nodes, parent, _weights(LEVELS[depth], weights.get(LEVELS[depth][1:], {})))
        down = shared.select(*[F.col(k).alias(f"up{k}") for k in keys], F.col("share").alias("grant"))
    joined = sized.join(down, [F.col(k).eqNullSafe(F.col(f"up{k}")) for k in LEVELS])
    return joined.select(*LEVELS, "tokens", F.least(F.ceil(F.round(F.col("grant"), 6)).cast("long"), F.col("capacity")).alias("budget"))


def _counted(docs: DataFrame, domain: Column, key: str, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("_key"), content(docs).alias("_row"), domain.cast("string").alias("_domain"), F.col(lang).cast("string").alias("_lang"),
        F.col(source).cast("string").alias("_source"), n_tokens(F.col(text)).alias("_tokens"),
    )


def _place(epochs: Column, key: Column, row: Column, max_epochs: int, seed: int) -> Column:
    """The place in the epoch after the whole ones."""
    place = F.lit(0).cast("long")
    for epoch in range(max_epochs):
        place = F.when(epochs == epoch, digest(key, row, epoch, seed)).otherwise(place)
    return place


def _reached(rows: DataFrame, of: list[str], level: str) -> DataFrame:
    """Per leaf the value of a level with which the tokens so far reach what is left, the
    tokens before it, and its own tokens and rows. ``rows``: of, left, before, _tokens."""
    values = rows.groupBy(*of, "left", "before", level).agg(F.sum("_tokens").alias("own"), F.count("*").alias("rows"))
    earlier = Window.partitionBy(*of).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.col("before") + F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    return values.where("before < left and before + own >= left")


def cut_points(docs: DataFrame, domain: Column, budget_share: float, weights: dict, max_epochs: int, seed: int,
               key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Per leaf: whole ``epochs``, the last place ``upto`` and row hash ``upto_row`` taken of
    the next one, and, if not ``all`` of the rows with that hash, how many: ``copies``."""
    counted = staged(_counted(docs, domain, key, lang, source, text))
    leaves = counted.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"))
    leaves = leaf_budgets(leaves, F.col("tokens") * budget_share, weights, max_epochs)
    leaves = staged(leaves.select(
        *[F.col(k).alias(f"of{k}") for k in LEVELS], "tokens", "budget",
        F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("left")))
    of = [f"of{k}" for k in LEVELS]

    def among(rows: DataFrame, found: DataFrame, level: str) -> DataFrame:
        """The rows of the leaf's value, with the tokens before it."""
        names = {c: f"in_{c}" for c in (*of, level, "before")}
        found = found.select(*[F.col(c).alias(n) for c, n in names.items()])
        same = [F.col(c).eqNullSafe(F.col(names[c])) for c in (*of, level)]
        return rows.join(found, same).select(*[c for c in rows.columns if c != "before"], F.col("in_before").alias("before"))

    same = [F.col(k).eqNullSafe(F.col(f"of{k}")) for k in LEVELS]
    sliced = lambda bits: F.shiftright(bits, DIGEST_BITS - SLICES.bit_length() + 1)
    rows = counted.join(leaves, same).where("left > 0").select(
        *of, "left", F.lit(0).cast("long").alias("before"), "_tokens", "_row",
        _place(F.col("epochs"), F.col("_key"), F.col("_row"), max_epochs, seed).alias("place"))
    rows = rows.withColumn("slice", sliced("place")).withColumn("row_slice", sliced("_row"))
    rows = staged(among(rows, _reached(rows, of, "slice"), "slice"))
    for level in ("place", "row_slice"):
        rows = among(rows, _reached(rows, of, level), level)
    last = _reached(rows.withColumn("upto", F.struct("place", "_row")), of, "upto")
    # Rows with one hash are equal; each has the same tokens.
    copies = F.ceil((F.col("left") - F.col("before")) * F.col("rows") / F.col("own"))
    last = last.select(
        *[F.col(c).alias(f"at_{c}") for c in of], F.col("upto.place").alias("upto"), F.col("upto._row").alias("upto_row"),
        F.least(copies, "rows").alias("copies"), (copies >= F.col("rows")).alias("all"))
    return leaves.join(last, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in of], "left").select(
        *of, "tokens", "budget", "epochs", "upto", "upto_row", "copies", "all")


def mixed(docs: DataFrame, domain: Column, budget_share: float, weights: dict[str, dict[str | None, float]] | None = None,
          max_epochs: int = 1, seed: int = 17, epoch_column: str | None = None,
          key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The chosen documents with their own columns, once for each epoch that takes them.

    ``budget_share``: the budget as a part of all tokens of the documents. ``weights``: of
    domains, languages and sources by name, under "domain", "lang", "source"; 1 if absent.
    ``epoch_column`` names a column for the epoch, from 0; without it copies are equal."""
    cuts = staged(cut_points(docs, domain, budget_share, weights or {}, max_epochs, seed, key, lang, source, text))
    cuts = cuts.select([F.col(c).alias(f"_mix_{c}") for c in cuts.columns])
    leaf = zip(LEVELS, (domain, F.col(lang), F.col(source)), strict=True)
    joined = docs.join(cuts, [value.cast("string").eqNullSafe(F.col(f"_mix_of{level}")) for level, value in leaf])
    epochs, row = F.col("_mix_epochs"), content(docs)
    here = F.struct(_place(epochs, F.col(key), row, max_epochs, seed), row)
    last = F.struct("_mix_upto", "_mix_upto_row")
    placed = joined.withColumns({"_mix_before": F.coalesce(here < last, F.lit(False)), "_mix_last": F.coalesce(here == last, F.lit(False))})
    inside = F.col("_mix_before") | (F.col("_mix_last") & F.col("_mix_all"))
    taken = placed.withColumn("_mix_times", epochs + inside.cast("int")).where("_mix_times > 0")
    columns = [F.col(c) for c in docs.columns]
    out = taken.select(*columns, F.explode(F.sequence(F.lit(0), F.col("_mix_times") - 1)).alias("_mix_epoch"))
    if cuts.where("not _mix_all").take(1):
        # Of rows equal in all columns some are taken: they are counted, then given back.
        some = placed.where("_mix_last and not _mix_all").groupBy(*columns, "_mix_epochs", "_mix_copies").agg(F.count("*").alias("_mix_rows"))
        some = some.select(*columns, F.col("_mix_epochs").alias("_mix_epoch"), F.explode(F.sequence(F.lit(1), F.least("_mix_rows", "_mix_copies"))).alias("_"))
        out = out.unionByName(some.drop("_"))
    return out.withColumnRenamed("_mix_epoch", epoch_column) if epoch_column else out.drop("_mix_epoch")
