"""Mixing sources to target weights, in blocks of tokens.

Each source's documents lie end to end and are cut into blocks of a fixed number of tokens. A recipe's
output shards draw how many blocks they take of each source (multinomial); a source's successive draws
run through its blocks in a pseudorandom order, anew in each round, so that no block is used again
before all are used, and none more than the cap allows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.functions.lineage import cut
from foliora.functions.rows import map_rows
from foliora.llm.tokens import TOKENIZERS, count_column

BLOCK = 2048  #: tokens of a block
SHARD = 4096  #: slots of an output shard
BUCKETS = 512  #: parts of each source for which running sums are made apart


def document_tokens(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Document, source and number of tokens."""
    return count_column(documents, ["doc_id", "source"], "text", folder)


def targets(tokens: DataFrame, recipes: DataFrame) -> DataFrame:
    """What each row of the recipes asks for and what its source can give, in tokens.

    A recipe's size is its ``mix_factor`` times the tokens of all documents. A source without documents
    can give nothing; a null share or cap makes the row's numbers null and not ``unreachable``."""
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    totals = totals.withColumn("all_tokens", F.sum("source_tokens").over(W.partitionBy()))
    rows = recipes.select("recipe_id", "source", "target_share", "max_repeats", "mix_factor").distinct()
    # one row for each source or row of the recipes on either side, whatever the size of the corpus; the outer
    # join keeps the total even where no recipe names a source
    joined = totals.join(rows, "source", "full_outer").withColumn("corpus_tokens", F.max("all_tokens").over(W.partitionBy())).where("recipe_id is not null")
    return joined.select(
        "recipe_id", "source", "target_share", "max_repeats", "mix_factor", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        (F.col("target_share") * F.col("mix_factor") * F.coalesce("corpus_tokens", F.lit(0))).alias("target_tokens"),
    ).withColumn("capacity_tokens", F.col("max_repeats") * F.col("source_tokens")).withColumn("unreachable", F.coalesce(F.col("target_tokens") > F.col("capacity_tokens"), F.lit(False)))


def found(documents: DataFrame, recipes: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Rows of the recipes whose target can't be reached within the repeat cap.

    They come from the draws of the mix: a source whose drawn slots run through its blocks as often as the cap
    allows, or come as close to it as rounding may make them, is held against its target in tokens."""
    t = cut(targets(document_tokens(documents, folder), recipes))
    drawn = _draws(t).groupBy("recipe_id", "source").agg(F.sum("n").alias("n"), F.sum("spare").alias("spare"), F.max(F.col("blocks") * F.col("cap")).alias("most"))
    full = drawn.where(F.col("n") + F.col("spare") >= F.col("most")).select("recipe_id", "source")
    return t.where("unreachable").join(full, ["recipe_id", "source"], "left_semi").select("recipe_id", "source").distinct()


def place(tokens: DataFrame) -> DataFrame:
    """Each document's place in its source, in tokens from 0.

    Running sums are made in ``BUCKETS`` parts of each source and shifted by the sums of the parts
    before, so a source that holds most documents is spread over as many tasks."""
    t = tokens.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    sums = t.groupBy("source", "part").agg(F.sum("n_tokens").alias("m"))
    before = sums.withColumn("shift", F.coalesce(F.sum("m").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = W.partitionBy("source", "part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)
    a, b = t.withColumn("upto", F.sum("n_tokens").over(within)).alias("a"), before.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part")))
    return joined.select("a.doc_id", "a.source", "a.n_tokens", (F.col("shift") + F.col("upto") - F.col("a.n_tokens")).alias("start_token"))


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def permuted(i: int, n: int, seed: int) -> int:
    """Place of ``i`` in a pseudorandom order of ``range(n)``, found without making the order (cycle-walking Feistel network)."""
    if n <= 1:
        return 0
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    x = i
    while True:
        left, right = x >> half, x & mask
        for r in range(4):
            f = ((right + 1) * 0x9E3779B97F4A7C15 + seed * (2 * r + 1)) & 0xFFFFFFFFFFFFFFFF
            f ^= f >> 31
            f = (f * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            left, right = right, left ^ (f >> 32 & mask)
        x = left << half | right
        if x < n:
            return x


def _draws(t: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """How many slots of every shard of every recipe each source gets, from the rows of ``targets``.

    A source is drawn by the slots that its target fills with its mean block, since its last block, perhaps its
    only one, holds what is left. The whole part of what a shard owes a source is given; the rest of its slots are
    drawn (multinomial, no source twice), so that sums over shards stay near the targets; ``spare`` bounds how far a shard is off."""
    t = t.where("target_tokens is not null and source is not null").withColumn("blocks", F.ceil(F.col("source_tokens") / block).cast("bigint"))
    t = t.withColumn("want", F.col("target_tokens") / F.when(F.col("blocks") > 0, F.col("source_tokens") / F.col("blocks")).otherwise(F.lit(block)))
    size = t.groupBy("recipe_id").agg(
        F.ceil(F.sum("want")).cast("bigint").alias("slots"),
        F.array_sort(F.collect_list(F.struct("source", "want", "blocks", F.col("max_repeats").alias("cap")))).alias("of"),
    )
    shards = size.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / shard).cast("int"))).alias("shard")).where("slots > 0").repartition("recipe_id", "shard")

    def draw(recipe, n, of, s):
        rng = np.random.default_rng(_seed(seed, recipe, s))
        p = np.array([max(0.0, x["want"]) for x in of])
        if p.sum() > 0:
            total = min(shard, n - s * shard)
            owed = total * p / p.sum()
            whole = np.floor(owed)
            left = int(total - whole.sum())
            counts = whole
            if left:
                counts[rng.choice(len(of), left, replace=False, p=(owed - whole) / (owed - whole).sum())] += 1
            for x, c in zip(of, counts):
                yield recipe, s, x["source"], int(c), x["blocks"], x["cap"], total, 1

    return map_rows(shards, ["recipe_id", "slots", "of", "shard"], draw, "recipe_id string, shard int, source string, n bigint, blocks bigint, cap int, size int, spare bigint")


def slots(tokens: DataFrame, recipes: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """The plan of every recipe: recipe, shard, slot, source, block of the source and round (from 0).

    A slot whose source has run through its blocks as often as the cap allows stays out of the plan; the
    shortfall shows in ``shares``. The slots of a shard are numbered from 0 without gaps but for those."""
    drawn = _draws(targets(tokens, recipes), block, shard, seed)
    # a row for each shard and source here, a small part of the slots
    upto = F.coalesce(F.sum("n").over(W.partitionBy("recipe_id", "source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("recipe_id", "shard").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("first", upto).withColumn("ahead", ahead)

    def fill(recipe, s, source, n, blocks, cap, size, first, ahead):
        order = _seed(seed, recipe, s, "order")
        for j in range(n):
            index = first + j
            if blocks and cap and index < blocks * cap:
                rnd = index // blocks
                yield recipe, s, permuted(ahead + j, size, order), source, permuted(index % blocks, blocks, _seed(seed, source, rnd)), int(rnd)

    return map_rows(placed, ["recipe_id", "shard", "source", "n", "blocks", "cap", "size", "first", "ahead"], fill, "recipe_id string, shard int, slot bigint, source string, block bigint, round int")


def shares(documents: DataFrame, recipes: DataFrame, folder: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """Target and actual share of each source of each recipe, what part of its target it reached, and how often its most used block is used."""
    tokens = cut(document_tokens(documents, folder))
    t = targets(tokens, recipes)
    sizes = t.select("recipe_id", "source", "source_tokens")
    # a source's last block holds what is left
    held = F.least(F.lit(block), F.col("source_tokens") - F.col("block") * block)
    plan = slots(tokens, recipes, block).join(sizes, ["recipe_id", "source"]).groupBy("recipe_id", "source").agg(F.sum(held).alias("actual"), (F.max("round") + 1).alias("rounds"))
    done = t.join(plan, ["recipe_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual", F.lit(0)).cast("bigint"))
    per_recipe = W.partitionBy("recipe_id")
    return done.select(
        "recipe_id", "source", "target_share", F.try_divide("actual_tokens", F.sum("actual_tokens").over(per_recipe)).alias("actual_share"), F.col("source_tokens").cast("bigint").alias("source_tokens"), "target_tokens", "actual_tokens",
        F.try_divide("actual_tokens", "target_tokens").alias("of_target"), F.coalesce("rounds", F.lit(0)).alias("rounds"), "max_repeats", "unreachable",
    )


def mixed(documents: DataFrame, recipes: DataFrame, folder: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """The mix itself, as the documents' token ranges in each slot: blocks are joined to the plan by index."""
    tokens = cut(document_tokens(documents, folder))
    at = place(tokens).where("n_tokens > 0").withColumn("end_token", F.col("start_token") + F.col("n_tokens"))
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_token") / block), F.floor((F.col("end_token") - 1) / block))))
    parts = pieces.select(
        "source", "block", "doc_id",
        (F.greatest(F.col("start_token"), F.col("block") * block) - F.col("start_token")).alias("from_token"),
        (F.least(F.col("end_token"), (F.col("block") + 1) * block) - F.col("start_token")).alias("to_token"),
    )
    # both sides grow with the corpus
    return slots(tokens, recipes, block).join(parts.hint("merge"), ["source", "block"]).select("recipe_id", "shard", "slot", "round", "source", "block", "doc_id", "from_token", "to_token")
