"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

All words are dealt as blocks of equal size, small enough that the smallest source has many: the work of
dealing doesn't grow with their number. Sources get blocks by the highest quotients target/(2k+1);
a source's blocks are dealt to its shards (hash ranges of its documents) in the same way by the shards'
words. A shard is read as one stream of words, its documents in a seeded order, as often as its quota
needs: whole passes over the shard, then the leading blocks of one more. Words, targets and quotas are
aggregates of a row for each source and shard. Orders over all sources, or over all shards of a source, are
running sums within ranges, so no task holds all of them; a window holds one range or one shard's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stats import prefix_sums
from .common import WORD, materialise

#: Weights by the source's rank, repeating; largest multiple of a source's words that a mix takes.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a source's shard, and blocks for each shard, on average.
SHARD_ROWS, SHARD_BLOCKS = 2_000, 1_000
#: Blocks at least in the most that the smallest source may give; the rest of a block, below a thousandth of that, is all it can lose.
SOURCE_BLOCKS = 1_000
SEED = 42
_DEC = "decimal(38,0)"


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also weight and target, one row for each source.

    Sources rank by code point. Targets are level * weight, stopped at ``most`` * source_size: in the order
    of stop / weight the stopped sources come first, so running sums give the level at which nothing is
    left to reshare. Comparisons are between exact integers.
    """
    named = prefix_sums(sizes.withColumn("__one", F.lit(1)), "source", ["__one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__one_upto") - 1) % len(weights) + 1).cast("int"))
    s = named.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast(_DEC).alias("stop"), F.col("source_size").cast(_DEC).alias("words"))
    s = prefix_sums(s.withColumn("__order", F.struct((F.col("stop") / F.col("weight")).alias("level"), "source")), "__order", ["stop", "weight", "words"])
    left = F.col("words_all") - (F.col("stop_upto") - F.col("stop"))
    open_weight = F.col("weight_all") - (F.col("weight_upto") - F.col("weight"))
    # stopped if the level of the sources from this one on would carry it beyond its stop
    s = s.withColumn("is_stopped", left * F.col("weight") > F.col("stop") * open_weight)
    free = s.agg(F.coalesce(F.sum(F.when(F.col("is_stopped"), F.col("stop"))), F.lit(0)).cast("double").alias("stops"), F.sum(F.when(~F.col("is_stopped"), F.col("weight"))).alias("free"))
    s = s.crossJoin(F.broadcast(free))
    shared = F.try_divide((F.col("words_all").cast("double") - F.col("stops")) * F.col("weight"), F.col("free"))
    target = F.when(F.col("is_stopped"), F.col("stop").cast("double")).otherwise(F.least(shared, F.col("stop").cast("double")))
    return s.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _with(rows: DataFrame, per_group: DataFrame, group: list[str]) -> DataFrame:
    return rows.join(per_group, group) if group else rows.crossJoin(F.broadcast(per_group))


def apportion(rows: DataFrame, group: list[str], votes: str, seats: str, limit: str, tie: str, name: str) -> DataFrame:
    """Adds ``name``: each row's share of its group's ``seats`` by Sainte-Lague on ``votes``, at most ``limit``.

    Seats go to the highest quotients votes/(2k+1). For n rows and S seats, a row with the share q of all
    votes gets at least floor(q (S - n/2) + 1/2) seats, since that many in each row never make more than S,
    and at most floor(q (S + n/2) + 1/2) + 1. Only the quotients between are ranked: about 3 n in a group,
    whatever S is. Seats that limits leave over stay undealt. ``group`` and ``tie`` together name a row.
    """
    kept = rows.columns
    totals = rows.groupBy(*group).agg(F.sum(F.col(votes).cast("decimal(38,3)")).cast("double").alias("__votes"), (F.count(F.lit(1)) / 2).alias("__half"))
    rows = _with(rows, totals, group).withColumn("__share", F.coalesce(F.try_divide(F.col(votes).cast("double"), F.col("__votes")), F.lit(0.0)))
    sure = F.floor(F.col("__share") * F.greatest(F.lit(0.0), F.col(seats) - F.col("__half")) + 0.5).cast("long")
    top = F.floor(F.col("__share") * (F.col(seats) + F.col("__half")) + 0.5).cast("long") + 1
    rows = rows.select(*kept, F.least(sure, F.col(limit)).alias("__sure"), top.alias("__top"))
    some = rows.withColumn("__k", F.explode(F.sequence(F.col("__sure"), F.greatest("__sure", "__top")))).where((F.col("__k") < F.col(limit)) & (F.col(votes) > 0))
    falling = F.struct(*group, (-F.col(votes).cast("double") / (2 * F.col("__k") + 1)).alias("falling"), tie, "__k")
    ranked = prefix_sums(some.select(*group, tie, falling.alias("__order"), F.lit(1).alias("__one")), "__order", ["__one"])
    # a group's quotients stand together, so a place in it is the place among all less those before the group
    before = ranked.groupBy(*group).agg((F.min("__one_upto") - 1).alias("__before"))
    left = rows.groupBy(*group).agg((F.first(seats) - F.sum("__sure")).alias("__left"))
    won = _with(_with(ranked, before, group), left, group).where(F.col("__one_upto") - F.col("__before") <= F.col("__left"))
    won = won.groupBy(*dict.fromkeys([*group, tie])).agg(F.count(F.lit(1)).alias("__won"))
    return rows.join(won, list(dict.fromkeys([*group, tie])), "left").select(*kept, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias(name))


def mix(docs: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``key``, size, source_size, target and taken (words, repeats counted) of every row.

    A null text has size 0 and gives nothing; a null source is a source of its own. The seeded order is a
    digest of the key, so that reruns agree whatever the partitions are; rows that repeat a key tie, and as
    the next order is by size it does not matter which of those still tied comes first. Texts of any length
    are counted whole; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    out = _dealt(docs, key, column, source, weights, most, seed)
    return out.select(F.col("id").alias(key), "size", "source_size", "target", "taken")


def _dealt(docs: DataFrame, key: str, column: str, source: str, weights: tuple[int, ...], most: int, seed: int, whole: bool = False) -> DataFrame:
    """:func:`mix` with the key as id; with ``whole`` also doc, the row itself as a struct, so that nothing is joined back by key.

    Then rows that tie in key and size come in the order of their texts' hash: one of them may be cut.
    """
    # 'a' before a name and 'b' for null: plain equality joins, and null ranks last
    named = F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(F.col(column)).alias("tie")] if whole else []
    rows = docs.select(F.col(key).alias("id"), named.alias("source"), word_count(column).alias("size"), draw.alias("draw"), *row)
    rows, _ = materialise(rows, "sizes")
    # a source has shards by its own rows, so that a hot one has more of them and not larger ones; the table of
    # their numbers is written first, so that adaptive execution can split the hot source's side of the join
    shards, _ = materialise(rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("long").alias("shards")), "shards")
    rows = rows.join(shards, "source").withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards")).drop("shards")
    cells, _ = materialise(rows.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, most)
    words, least = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))).first()
    block = words // (SHARD_BLOCKS * max(1, shards.agg(F.sum("shards").alias("n")).first().n or 0))
    block = max(1, min(block, least * most // SOURCE_BLOCKS))
    quotas = targets.withColumns({"seats": F.lit(words // block).cast("long"), "room": F.floor(F.col("source_size") * most / block).cast("long")})
    quotas = apportion(quotas, [], "target", "seats", "room", "source", "source_blocks")
    quotas, _ = materialise(quotas.select("source", "source_size", "target", "source_blocks"), "source-quotas")
    cells = cells.join(quotas, "source").withColumn("room", F.ceil(F.col("cell_size") * most / block).cast("long"))
    cells = apportion(cells, ["source"], "cell_size", "source_blocks", "room", "shard", "cell_blocks")
    dealt = F.least(F.col("cell_blocks") * block, F.col("cell_size") * most).alias("cell_words")
    cells, _ = materialise(cells.select("source", "shard", "cell_size", "source_size", "target", dealt), "quotas")
    so_far = W.partitionBy("source", "shard").orderBy("draw", "size", *["tie"] * whole).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("before", F.sum("size").over(so_far) - F.col("size")).join(cells, ["source", "shard"])
    passes = F.floor(F.try_divide(F.col("cell_words"), F.col("cell_size")))
    rest = F.col("cell_words") - passes * F.col("cell_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = F.coalesce(passes * F.col("size") + part, F.lit(0)).cast("long")
    return out.select("id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), *["doc"] * whole)


def mixed_documents(docs: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", length: str = "n_chars", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole time a document is taken.

    The document at the edge of a shard's last block also gives a row cut at that edge (its leading words
    with the white space between them; ``length`` then holds the cut text's). Keys may be null or repeated:
    each row is taken by its own count. Rows without words give nothing; very long texts and columns of any
    name but those that begin with ``__`` are allowed; an empty table gives no rows.
    """
    dealt = _dealt(docs, key, column, source, weights, most, seed, whole=True).where("taken > 0")
    rows = dealt.select("doc.*", F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    cut = (F.col("__taken") - whole * F.col("__size")).cast("int")
    rows = rows.withColumn("__words", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))))
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col(column), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.greatest(F.col("__words"), F.lit(1))), "")
    text = F.when(F.col("__words") > 0, lead).otherwise(F.col(column))
    made = {column: text} | ({length: F.when(F.col("__words") > 0, F.length(lead)).otherwise(F.col(length)).cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
