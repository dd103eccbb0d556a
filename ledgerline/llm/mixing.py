"""Mixing sources to target weights by temperature (DataFrame functions only).

The token share of each source is raised to an exponent and normalised; the
exponent (1: as it is, 0: all alike) is bisected until the weights just meet a
target entropy or a repetition limit. The weights become budgets, and each
source is read in passes: every pass is a permutation of the source's blocks,
whole passes as often as the budget holds the source, then blocks in order until
it is spent, the last block's documents in an order of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..operators._joins import bounded_broadcast
from ._shared import cut

BLOCK_TOKENS = 1 << 20     # a block holds about so many tokens, more where that would make ...
MOST_BLOCKS = 100_000      # ... more blocks than this: the plan of a mixture stays this small at any size
LEVELS = 4                 # bisection steps answered by one pass over the shares
STEPS = 24                 # bisection steps in all
ROUNDS = 6                 # how often the room left in a last block is offered to documents that fit it
SMALL_SOURCES = 100_000    # up to so many sources their rows are sent to every task


def estimated_tokens(text):
    """A token for every four bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def draw(*parts):
    """A number below 2**32 from the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def shares(docs: DataFrame, source_col: str = "source", tokens=None) -> DataFrame:
    """source, tokens, docs per source; a null source is one of its own."""
    tokens = estimated_tokens(docs["text"]) if tokens is None else tokens
    return docs.select(docs[source_col].alias("source"), tokens.alias("tokens")).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def exponent(sizes: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent, rounded to six places; 1 where the shares meet the target as they are.

    ``target_entropy`` is a share of the entropy of equal weights (0 to 1): the
    largest exponent that reaches it. ``max_repeats`` bounds how much more often
    the rarest source is read than the commonest: the smallest exponent that
    keeps it. ``sizes`` holds (tokens); every probe is an aggregate over it.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("one of target_entropy and max_repeats")
    total = sizes.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if not total["n"] or total["lo"] == total["hi"]:
        return 1.0
    p = F.col("tokens") / F.lit(float(total["t"]))

    def entropies(at: list[float]) -> dict:
        sums = [c for i, a in enumerate(at) for c in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.ln(p)).alias(f"s{i}"))]
        row = sizes.agg(*sums).first()
        return {a: math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"] for i, a in enumerate(at)}

    def wants_lower(at: list[float]) -> dict:
        if max_repeats is not None:  # of weight / share: (rarest / commonest) ** (exponent - 1)
            return {a: (total["lo"] / total["hi"]) ** (a - 1) <= max_repeats for a in at}
        return {a: h < target_entropy * math.log(total["n"]) for a, h in entropies(at).items()}

    low, high = 0.0, 1.0
    ends = wants_lower([low, high])
    if max_repeats is None and not ends[high]:
        return 1.0
    if max_repeats is not None and ends[low]:
        return 0.0
    for _ in range(STEPS // LEVELS):
        inner = [low + (high - low) * i / 2 ** LEVELS for i in range(1, 2 ** LEVELS)]
        lower = wants_lower(inner)
        for _ in range(LEVELS):
            mid = min(inner, key=lambda a: abs(a - (low + high) / 2))
            low, high = (low, mid) if lower[mid] else (mid, high)
    return round(low if max_repeats is None else high, 6)


def budgets(sizes: DataFrame, power: float, budget_tokens: int | None) -> DataFrame:
    """source, tokens, docs, weight, budget, passes (whole ones) and rest (tokens of the last one).

    Without ``budget_tokens`` the corpus grows until no source loses anything:
    the source with the least weight for its size is read exactly once.
    """
    t = sizes.agg(F.sum("tokens").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))).alias("z"),
                  F.max(F.pow(F.col("tokens").cast("double"), F.lit(1 - power))).alias("most")).first()
    weight = F.pow(F.col("tokens").cast("double"), F.lit(power)) / F.lit(t["z"] or 1.0)
    spent = weight * F.lit(float(budget_tokens)) if budget_tokens is not None else weight * F.lit((t["z"] or 1.0) * (t["most"] or 1.0))
    budget = F.round(spent).cast("bigint")
    budget = budget if budget_tokens is not None else F.greatest(budget, F.col("tokens"))
    out = sizes.withColumns({"weight": weight, "budget": budget})
    return out.withColumns({"passes": F.floor(F.col("budget") / F.col("tokens")).cast("int"), "rest": F.expr("budget % tokens")})


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens=None, seed: int = 0,
        block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture: all columns of ``docs``, a row for each time a document is read, and four more.

    mix_pass (0, 1, ...), mix_block, mix_rank (the block's place in its pass)
    and mix_tokens; reading a pass is reading its blocks by rank and a block's
    documents by their draw. ``docs`` must not have columns of these names.
    ``tokens`` is a Column with token counts; without it four bytes are a token.

    Where a budget ends inside a block, its documents are taken by their draw as
    long as they fit; in ``ROUNDS`` rounds those that didn't are passed over and
    the room that is left is offered to the others. What stays unspent is less
    than the next of them in the last round, and nothing else is left out.

    A hot source is many blocks, so nothing is ordered within a source but its
    blocks, at most ``MOST_BLOCKS`` in all, and the documents of the one block
    that a budget ends in. A null source is a source of its own; null and empty
    texts count one token; repeated rows are drawn together; a text longer than
    all its source's budget is not read in a pass that can't hold it; an empty
    table gives no rows. Any other column names are allowed in ``docs``, and the
    four added ones raise ValueError.
    """
    if clash := {"mix_pass", "mix_block", "mix_rank", "mix_tokens"} & set(docs.columns):
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    names = docs.columns
    at = {c: f"c{names.index(c)}" for c in (id_col, source_col)}
    counted = docs.withColumn("mix_tokens", estimated_tokens(docs[text_col]) if tokens is None else tokens)
    own = counted.toDF(*[f"c{i}" for i in range(len(names))], "mix_tokens")   # no name of the input meets one of ours
    ident, source = F.col(at[id_col]), F.col(at[source_col])
    sizes = cut(shares(own, at[source_col], F.col("mix_tokens")))
    plan = cut(budgets(sizes, exponent(sizes, target_entropy, max_repeats), budget_tokens))
    facts = plan.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    size = max(block_tokens, (facts["t"] or 0) // MOST_BLOCKS + 1)
    blocks = plan.select(F.col("source").alias("mix_source"), F.ceil(F.col("tokens") / F.lit(size)).cast("bigint").alias("mix_blocks"))
    blocks = F.broadcast(blocks) if facts["n"] <= SMALL_SOURCES else blocks
    sized = own.join(blocks, source.eqNullSafe(F.col("mix_source")))
    sized = sized.withColumn("mix_block", F.pmod(draw(F.lit(seed), ident), F.col("mix_blocks"))).drop("mix_blocks")

    held = sized.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("size"))
    turns = cut(_turns(held, plan, seed))
    n = turns.count()
    small = (lambda df: F.broadcast(df)) if n <= 4 * MOST_BLOCKS else (lambda df: df)
    same = sized["mix_source"].eqNullSafe(turns["t_source"]) & (sized["mix_block"] == turns["t_block"])
    out = [f"c{i}" for i in range(len(names))] + ["mix_tokens", "mix_block", "mix_pass", "mix_rank"]
    whole = sized.join(small(turns.filter("room IS NULL")), same).select(out)
    part = _fitting(sized.join(small(turns.filter("room IS NOT NULL")), same), ident, seed).select(out)
    return whole.unionByName(part).toDF(*names, *out[len(names):])


def _fitting(part: DataFrame, ident, seed: int) -> DataFrame:
    """The documents that fit the ``room`` of their block, by draw, in rounds; one sort serves all of them."""
    from pyspark.sql import Window as W
    block = W.partitionBy("t_source", "t_block", "mix_pass")
    upto = block.orderBy(draw(F.lit(seed), F.col("mix_pass"), F.lit("doc"), ident), ident).rangeBetween(W.unboundedPreceding, 0)
    part = part.withColumn("taken", F.lit(False))
    for _ in range(ROUNDS):
        part = part.withColumn("fits", ~F.col("taken") & (F.col("mix_tokens") <= F.col("room")))
        part = part.withColumn("spent", F.sum(F.when(F.col("fits"), F.col("mix_tokens")).otherwise(0)).over(upto))
        part = part.withColumn("now", F.col("fits") & (F.col("spent") <= F.col("room")))
        part = part.withColumn("room", F.col("room") - F.max(F.when(F.col("now"), F.col("spent")).otherwise(0)).over(block))
        part = part.withColumn("taken", F.col("taken") | F.col("now"))
    return part.filter("taken")


def _turns(held: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """t_source, t_block, mix_pass, mix_rank, room (null: the whole block; else tokens left for it)."""
    from pyspark.sql import Window as W
    plan = plan.select(F.col("source").alias("p_source"), "passes", "rest")
    turns = held.join(bounded_broadcast(plan), F.col("mix_source").eqNullSafe(F.col("p_source")))
    turns = turns.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    by_draw = W.partitionBy("mix_source", "mix_pass").orderBy(draw(F.lit(seed), F.col("mix_pass"), F.col("mix_source"), F.col("mix_block")), "mix_block")
    turns = turns.withColumns({"mix_rank": F.row_number().over(by_draw), "upto": F.sum("size").over(by_draw.rowsBetween(W.unboundedPreceding, 0))})
    left = F.col("rest") - (F.col("upto") - F.col("size"))
    room = F.when((F.col("mix_pass") < F.col("passes")) | (F.col("upto") <= F.col("rest")), F.lit(None)).otherwise(left)
    turns = turns.withColumn("room", room.cast("bigint"))
    return turns.filter("room IS NULL OR room > 0").select(F.col("mix_source").alias("t_source"), F.col("mix_block").alias("t_block"), "mix_pass", "mix_rank", "room")
