"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts of the cells (source, language, topic) are raked: in turn the weights of each marginal's categories are
scaled to their target shares, until nothing changes or for ROUNDS rounds.  A document is then kept with the probability that its cell's raked share
needs of the token budget; what cells cannot give, because all their documents are kept already, the others do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: A category's target share is its own share to this power, made to add up to 1: 1 keeps the mix, 0 makes it even.
TEMPERING = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 20
#: Share of all tokens to keep.
KEEP = 0.8
#: Cells up to this many are raked in one task without a shuffle; more by factors, with the same shares.
ONE_TASK_CELLS = 100_000
#: Raking ends when no cell's share changes by more than this part of itself.
SETTLED = 1e-13
#: Rounds between two tables that cut the lineage.
_STRETCH = 5
_NONE = "(none)"


def topic_of(text: Column) -> Column:
    """Topic by form: table, notice (of a license), contact (a mail address or a phone number) or prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(F.lower(text).contains("license"), "notice")
        .when(text.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+|\+[0-9]+ "), "contact")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    """Words of a text between white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of seed and key: the same in every run and on every retry."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, dimension: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """(dimension, target): the share that each category shall have."""
    of = cells.groupBy(dimension).agg(F.sum("tokens").alias("n"))
    if given is not None:
        total = sum(given.values())
        pairs = [F.lit(x) for k, v in given.items() for x in (k, v / total)]
        return of.select(dimension, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(dimension)), F.lit(0.0)).alias("target"))
    of = of.select(dimension, F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(float(power)))).otherwise(0.0).alias("power"))
    total = of.agg(F.sum("power")).first()[0]
    return of.select(dimension, (F.col("power") / F.lit(total) if total else F.lit(0.0)).alias("target"))


def _raked_in_one_task(cells: DataFrame, goals: dict[str, DataFrame], rounds: int, tmp: Scratch) -> DataFrame:
    """For ONE_TASK_CELLS at most: windows over a single partition, so no step needs a shuffle."""
    for d in DIMENSIONS:
        cells = cells.join(goals[d].withColumnRenamed("target", f"target_{d}"), d)
    cells = tmp.written(cells.withColumn("share", F.col("tokens").cast("double")), "cells")
    for k in range(rounds):
        if k % _STRETCH == 0:
            cells = cells.coalesce(1)
        was = F.col("share").alias("was")
        cells = cells.select(*DIMENSIONS, "tokens", "share", was, *(f"target_{d}" for d in DIMENSIONS))
        for d in DIMENSIONS:
            sums = F.sum("share").over(Window.partitionBy(d))
            cells = cells.withColumn("share", F.when(sums > 0, F.col("share") * F.col(f"target_{d}") / sums).otherwise(0.0))
        if k % _STRETCH == _STRETCH - 1 or k == rounds - 1:
            cells = tmp.written(cells, "cells")
            if not cells.where(F.abs(F.col("share") - F.col("was")) > SETTLED * F.col("was")).limit(1).count():
                break
    return cells.select(*DIMENSIONS, "tokens", "share")


def _raked_by_factors(cells: DataFrame, goals: dict[str, DataFrame], rounds: int, tmp: Scratch) -> DataFrame:
    """For any number of cells: a raked share is the tokens times one factor for each dimension.

    A step sums the cells for each category of one dimension (map sides first) and writes that dimension's new factors;
    the cells themselves are never rewritten, and no category's cells meet in one task.
    """
    factors = {d: goals[d].select(d, F.lit(1.0).alias(f"factor_{d}")) for d in DIMENSIONS}
    for k in range(rounds):
        settled = True
        for d in DIMENSIONS:
            rest = cells
            share = F.col("tokens").cast("double")
            for other in DIMENSIONS:
                if other != d:
                    rest, share = rest.join(factors[other], other), share * F.col(f"factor_{other}")
            sums = rest.groupBy(d).agg(F.sum(share).alias("sum")).join(goals[d], d)
            new = sums.select(d, F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias(f"factor_{d}"))
            new = tmp.written(new, "factors")
            if settled and k % _STRETCH == _STRETCH - 1:
                both = new.join(factors[d].withColumnRenamed(f"factor_{d}", "was"), d)
                settled = not both.where(F.abs(F.col(f"factor_{d}") - F.col("was")) > SETTLED * F.col("was")).limit(1).count()
            factors[d] = new
        if settled and k % _STRETCH == _STRETCH - 1:
            break
    share = F.col("tokens").cast("double")
    for d in DIMENSIONS:
        cells, share = cells.join(factors[d], d), share * F.col(f"factor_{d}")
    return cells.select(*DIMENSIONS, "tokens", share.alias("share"))


def rake(cells: DataFrame, tempering: dict[str, float] | None = None, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with share: the raked share of each cell.

    targets gives shares of categories outright for a dimension; those that it does not name get none.
    """
    tempering = TEMPERING if tempering is None else tempering
    tmp = Scratch()
    cells = tmp.written(cells.select(*DIMENSIONS, "tokens"), "cells")
    goals = {d: tmp.written(_targets(cells, d, tempering.get(d, 1.0), (targets or {}).get(d)), "targets") for d in DIMENSIONS}
    few = cells.count() <= ONE_TASK_CELLS
    cells = tmp.written((_raked_in_one_task if few else _raked_by_factors)(cells, goals, rounds, tmp), "cells")
    total = cells.agg(F.sum("share")).first()[0]
    out = tmp.written(cells.withColumn("share", F.col("share") / F.lit(total) if total else F.lit(0.0)), "raked")
    tmp.clear(out)
    return out


def probabilities(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """raked with probability: tokens expected from all cells are keep times all tokens, as far as the cells can give them.

    A cell's expected tokens are its share at a common level, but no more than it has.  The level is found by steps: the
    cells that have too little at a level are taken whole, and the others share the rest of the budget, which raises it.
    """
    all_tokens = raked.agg(F.sum("tokens")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        short = (F.col("tokens") > 0) & (F.lit(level) * F.col("share") > F.col("tokens"))
        n, taken, rest = raked.agg(F.count_if(short), F.sum(F.when(short, F.col("tokens"))), F.sum(F.when((F.col("tokens") > 0) & ~short, F.col("share")))).first()
        if n == full or not rest:
            break
        full, level = n, max(0.0, keep * all_tokens - (taken or 0)) / rest
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(level) * F.col("share") / F.col("tokens"))).otherwise(1.0)
    return raked.withColumn("probability", F.round(chance, 9)).select(*DIMENSIONS, "tokens", "share", "probability")


def mix_sources(docs: DataFrame, keep: float = KEEP, seed: int = 17, tempering: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(row, topic, n_tokens, probability, weight, kept) of every document; row is the whole input row as a struct.

    weight is 1 / probability.  Defined cases: null or empty texts have no tokens, count in no marginal, and are kept
    (they cost nothing of the budget) if their cell has none either, else with the cell's probability; a null source,
    language or topic is a category of its own; repeated rows share one fate, as it hangs on the id; a null id is
    treated like the id `null`; further columns stay in row; an empty table gives an empty table.

    The cells are pre-aggregated; a source of any share of the rows is no more than its cells afterwards.
    """
    text = F.col(text_col).cast("string")
    parts = {
        "source": F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)),
        "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(_NONE)),
        "topic": F.coalesce(topic if topic is not None else topic_of(text), F.lit(_NONE)),
    }
    tmp = Scratch()
    rows = docs.select(F.struct("*").alias("row"), n_words(text).alias("n_tokens"), *(c.alias(d) for d, c in parts.items()), uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), seed).alias("u"))
    # the texts are looked at once: what both passes need of them is written beside the rows
    rows = tmp.written(rows, "mixing-rows")
    cells = tmp.written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    chances = tmp.written(probabilities(rake(cells, tempering, rounds, targets), keep).select(*DIMENSIONS, "probability"), "probabilities")
    tmp.clear(rows, chances)
    out = rows.join(chances, list(DIMENSIONS), "left")
    weight = F.when(F.col("probability") > 0, 1 / F.col("probability"))
    return out.select("row", "topic", "n_tokens", "probability", weight.alias("weight"), (F.col("u") < F.col("probability")).alias("kept"))
