"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source gets a target of tokens by weight, at most ``cap`` times what it has. Blocks of equal size are handed to
sources one by one to the highest quotient target / (2 k + 1), k being the blocks a source already has, and each
source's blocks are handed to its shards the same way. Only the blocks near the end of that race need to be looked at:
a party's number of blocks differs from its exact share by less than a bound that follows from its share, so all below
is certain. Within a shard, documents lie in a seeded order; a quota goes through them as often as it fills the whole
shard, and its last, partial round takes the first blocks. Everything is Spark SQL.

Windows without a key run over one row per source; those by source over one row per shard, which is one for about a
million tokens, and the few rows of the race for each. All larger tables are shuffled by source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverloom.llm import common

#: Most tokens of a block, least blocks of a source that has a target, and about how many tokens a shard of a source has.
BLOCK, LEAST_BLOCKS, SHARD = 64, 8, 1_000_000


def n_words(text: str | Column) -> Column:
    """Runs of characters that are neither blanks nor U+0009 to U+000D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(df: DataFrame, seed: int) -> Column:
    """A seeded hash of all columns of a row that can be hashed: rows that share an id, or have none, are spread."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def sainte_lague(parties: DataFrame, votes: str, seats: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``parties`` with a column ``won``: how many of ``seats`` each wins by the highest quotients votes / (2 k + 1).

    With ``by``, each group of parties shares the seats that its rows state. Equal quotients go to the party that comes
    first in ``order``. Parties without votes win nothing.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    total, n = F.sum(votes).over(group), F.count("*").over(group)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    exact = share * F.col(seats)
    room = F.ceil(share * (n / 2 + 1)) + 1
    party = parties.withColumn("__low", F.greatest(F.lit(0), F.floor(exact) - room).cast("long"))
    party = party.withColumn("__high", F.when(share > 0, (F.ceil(exact) + room).cast("long")).otherwise(F.lit(0)))
    party = party.withColumn("__open", F.col(seats) - F.sum("__low").over(group))
    race = party.where(F.col("__high") > F.col("__low")).withColumn("__k", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)))
    rank = F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("__k") + 1)), *order, "__k"))
    won = race.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__open"))
    keys = [*(by or []), *[c for c in order if c not in (by or [])]]
    more = won.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.count("*").alias("__more"))
    on = [common.same(F.col(c), F.col(f"__{c}")) for c in keys]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    out = party.join(more, condition, "left")
    return out.withColumn("won", F.col("__low") + F.coalesce("__more", F.lit(0))).select(*parties.columns, "won")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` (source, source_size) with weight, target.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share all sizes by weight; a target stops at
    ``cap`` times the source's size and what is over is shared again. The level at which no target is above its cap is
    found in one pass over the sources by rising cap per weight. The windows run over one row per source.
    """
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("__most", F.lit(float(cap)) * F.col("source_size"))
    all_ = Window.partitionBy(F.lit(0))
    rising = all_.orderBy(F.col("__most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("__most").over(before), F.lit(0.0))
    rows = rows.withColumn("__level", left / F.sum("weight").over(rest))
    fits = F.when(F.col("__level") * F.col("weight") <= F.col("__most"), F.col("__level"))
    level = F.first(fits, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.coalesce(F.least(F.col("__most"), F.col("weight") * level), F.col("__most")))
    return rows.select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    *,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (tokens that the mix takes, repeats counted).

    ``size`` is a column of whole numbers, by default the words of the text, however long. Sources that are null share a
    target of their own. Documents without tokens are kept with taken 0; an empty table gives an empty one. Rows that
    repeat are documents like others; between rows that agree in all columns it is open which of them is taken. Columns
    of ``docs`` that are named like the new ones are replaced. A block has at most ``block`` tokens, and so few that the
    smallest target has LEAST_BLOCKS of them, or one token. A source's shards and the order within them follow from a
    hash of the rows, so a source of any size is spread, whatever its ids, and reruns give the same.
    """
    size = n_words(text_col) if size is None else size
    new = ["size", "source_size", "target", "taken"]
    base = docs.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    base = base.withColumn("__source", F.col(source_col).cast("string"))
    base = base.withColumn("__hash", row_hash(docs, seed))
    sizes = base.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    plan = common.written(targets(sizes, weights, cap), "sources")
    all_ = Window.partitionBy(F.lit(0))
    fewest = F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_) / LEAST_BLOCKS)
    plan = plan.withColumn("__block", F.greatest(F.lit(1), F.least(F.lit(block), fewest)).cast("long"))
    plan = plan.withColumn("__seats", F.round(F.sum("target").over(all_) / F.col("__block")).cast("long"))
    plan = sainte_lague(plan, "target", "__seats", ["source"])
    plan = plan.withColumn("__shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long"))
    plan = common.written(plan.withColumnRenamed("won", "__blocks"), "quotas")
    own = plan.select(F.col("source").alias("__name"), "source_size", "target", "__shards", "__block", "__blocks")
    placed = base.drop(*[c for c in new if c in base.columns]).join(own, common.same(F.col("__source"), F.col("__name")))
    placed = placed.withColumn("__shard", F.pmod("__hash", "__shards")).drop("__name", "__shards")
    shards = placed.groupBy("__source", "__shard", "__blocks").agg(F.sum("__size").alias("__tokens"))
    shards = sainte_lague(shards, "__tokens", "__blocks", ["__source", "__shard"], by=["__source"])
    shards = common.written(shards.select("__source", "__shard", "__tokens", F.col("won").alias("__quota")), "shards")
    key = [F.col(c).alias(f"_{c}") for c in ("__source", "__shard")]
    quota = shards.select(*key, "__tokens", "__quota")
    on = common.same(F.col("__source"), F.col("___source")) & (F.col("__shard") == F.col("___shard"))
    line = Window.partitionBy("__source", "__shard").orderBy("__hash", id_col, "__size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = placed.drop("__blocks").join(quota, on).withColumn("__at", F.coalesce(F.sum("__size").over(line), F.lit(0)))
    amount = F.least(F.col("__quota") * F.col("__block"), F.floor(F.lit(float(cap)) * F.col("__tokens")))
    rounds = F.when(F.col("__tokens") > 0, F.floor(amount / F.col("__tokens"))).otherwise(F.lit(0)).cast("long")
    rest = amount - rounds * F.col("__tokens")
    part = F.greatest(F.lit(0), F.least(F.col("__at") + F.col("__size"), rest) - F.least(F.col("__at"), rest))
    taken = (rounds * F.col("__size") + part).cast("long")
    names = [c for c in docs.columns if c not in new]
    return dealt.select(*[F.col(f"`{c}`") for c in names], F.col("__size").alias("size"), "source_size", "target", taken.alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken: whole rounds, and once more where the last round takes half of it or more.

    Documents without tokens go.
    """
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    out = mixed.withColumn("__n", n).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.drop("__n", "__copy")
