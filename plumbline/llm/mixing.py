"""Mixing sources: raking token weights to marginals, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import hold

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Stems whose counts give a document its topic, in order of precedence on ties.
TOPIC_STEMS = ("tion", "ment", "heit", "ado", "ing", "the")
#: Probabilities and weights are rounded to this many digits, so that the order in which
#: doubles are added cannot change who is sampled.
DIGITS = 6


def topic_of(text: Column, stems: Sequence[str] = TOPIC_STEMS) -> Column:
    """The stem that covers most of the text, ``none`` where no stem occurs."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    covered = [F.length(lower) - F.length(F.replace(lower, F.lit(s), F.lit(""))) for s in stems]
    top = F.greatest(*covered)
    found = F.lit("none")
    for s, c in reversed(list(zip(stems, covered))):
        found = F.when((c == top) & (c > 0), F.lit(s)).otherwise(found)
    return found


def token_weight(text: Column) -> Column:
    """Words of a text; at least 1, so that an empty document still has a weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)), F.lit(1)).cast("long")


def uniform(key: Column) -> Column:
    """A fixed number in [0, 1) per key: 32 bits of its digest; rows without a key share one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered_targets(cells: DataFrame, dims: Sequence[str], power: float) -> dict[str, DataFrame]:
    """Per dimension (value, target): its token shares raised to ``power`` and normalised."""
    out = {}
    for d in dims:
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("s"))
        raised = sums.withColumn("p", F.pow("s", F.lit(float(power))))
        total = raised.agg(F.sum("p").alias("all")).select(F.col("all"))
        out[d] = raised.crossJoin(F.broadcast(total)).select(d, (F.col("p") / F.col("all")).alias("target"))
    return out


def rake(cells: DataFrame, dims: Sequence[str], targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Iterative proportional fitting: cells with ``weight``, whose marginals meet the targets.

    ``cells`` holds one row per combination of the dimensions with its ``tokens``. A value
    without a target keeps no weight. Each step scales the cells of a value by the target
    over its current share. All steps run on the cell table, which has as many rows as there
    are combinations; a value's cells are summed before they meet.
    """
    fitted = cells
    for d in dims:
        fitted = fitted.join(targets[d].select(F.col(d).alias("__v"), F.col("target").alias(f"__{d}")),
                             F.col(d).eqNullSafe(F.col("__v")), "left").drop("__v")
    total = Window.partitionBy(F.lit(0))
    fitted = hold(fitted.withColumn("weight", F.col("tokens") / F.sum("tokens").over(total)))
    for n in range(rounds):
        for d in dims:
            fitted = fitted.withColumn("weight", F.coalesce(F.try_divide(
                F.col("weight") * F.col(f"__{d}"), F.sum("weight").over(Window.partitionBy(d))), F.lit(0.0)))
        if n % 4 == 3 and n + 1 < rounds:
            fitted = hold(fitted)
    return fitted.drop(*[f"__{d}" for d in dims])


def budget_scale(budget: float) -> Column:
    """The c for which min(1, c * ``__r``) keeps a share ``budget`` of all ``tokens``; on the cell table.

    The kept tokens are the least, over k, of the tokens of the k cells with the greatest ratio
    plus c times the weight of the others, so c is the greatest of the solutions for each k.
    Where every cell that has a weight must stay whole, the last of them sets c.
    """
    whole = Window.partitionBy(F.lit(0))
    falling = whole.orderBy(F.desc("__r"))
    before = F.sum("tokens").over(falling) - F.sum("tokens").over(falling.rangeBetween(Window.currentRow, Window.currentRow))
    rest = F.sum("weight").over(falling.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    want = F.lit(float(budget)) * F.sum("tokens").over(whole)
    c = F.when(F.col("__r") > 0, F.least(F.try_divide(want - before, rest), F.lit(1.0) / F.col("__r")))
    return F.max(c).over(whole)


def sample_to_targets(df: DataFrame, dims: Sequence[str], key: str, tokens: str,
                      targets: dict[str, DataFrame] | None = None, power: float = 0.7,
                      rounds: int = 12, budget: float | None = None) -> DataFrame:
    """Add ``weight``, ``probability`` and ``kept`` to every row; ``tokens`` names a count column.

    A cell's probability is its raked weight over its tokens times a scale. Without ``budget``
    the scale makes the greatest probability 1: in expectation the kept tokens have exactly the
    fitted shares, but the cell with the greatest ratio, however small, decides how much of all
    others stays. With ``budget``, the share of all tokens to keep, the scale is solved from the
    cell table so that the probabilities, none above 1, keep that share in expectation: cells
    that would need more than they have stay whole and the others keep the fitted shares among
    themselves. Nothing is repeated. A row is kept if its key's fixed uniform number lies below
    its probability, so the outcome depends on neither order nor partitions; repeated rows share
    their fate. Without
    ``targets``, the token shares to the power ``power`` are the marginals, which lifts small
    sources and lowers large ones. Null values form a value of their own. Null tokens count
    as 0. An empty table stays empty. Existing columns of the three names are replaced.
    """
    if budget is not None and not 0 < budget <= 1:
        raise ValueError(f"budget {budget} is no share in (0, 1]")
    rows = df.drop("weight", "probability", "kept")
    names = [f"__d{i}" for i in range(len(dims))]
    keyed = rows.withColumns({n: F.coalesce(quoted(d).cast("string"), F.lit("\x00null"))
                              for n, d in zip(names, dims)})
    cells = hold(keyed.groupBy(*names).agg(F.coalesce(F.sum(quoted(tokens)), F.lit(0)).alias("tokens")))
    goal = ({n: targets[d].select(F.coalesce(quoted(d).cast("string"), F.lit("\x00null")).alias(n), "target")
             for n, d in zip(names, dims)} if targets else tempered_targets(cells, names, power))
    ratio = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")), F.lit(0.0))
    fitted = rake(cells, names, goal, rounds).withColumn("__r", ratio)
    if budget is None:
        scaled = F.try_divide(F.col("__r"), F.max("__r").over(Window.partitionBy(F.lit(0))))
    else:
        fitted, scaled = fitted.withColumn("__c", budget_scale(budget)), F.least(F.lit(1.0), F.col("__c") * F.col("__r"))
    table = hold(fitted.select(
        *names, F.round("weight", DIGITS).alias("weight"),
        F.round(F.coalesce(scaled, F.lit(0.0)), DIGITS).alias("probability")))
    # The size of this table is known by now, so the planner broadcasts it only if it is small.
    out = keyed.join(table, names).drop(*names)
    return out.withColumn("kept", uniform(quoted(key)) < F.col("probability"))


def oracle(power: float, rounds: int) -> str:
    """The same in DuckDB for documents by source, language and topic."""
    covers = ", ".join(f"length(low) - length(replace(low, '{s}', '')) AS c{i}" for i, s in enumerate(TOPIC_STEMS))
    cases = " ".join(f"WHEN c{i} = top AND c{i} > 0 THEN '{s}'" for i, s in enumerate(TOPIC_STEMS))
    tops = ", ".join(f"c{i}" for i in range(len(TOPIC_STEMS)))
    steps, last = [], "w0"
    for n in range(rounds):
        for d in ("source", "lang", "topic"):
            new = f"w{n}_{d}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, "
                         f"weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM {last})")
            last = new
    goals = ", ".join(f"g_{d} AS (SELECT {d}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS "
                      f"t_{d} FROM cells GROUP BY {d})" for d in ("source", "lang", "topic"))
    return f"""
WITH lowered AS (SELECT doc_id, coalesce(source, chr(0) || 'null') AS source, coalesce(lang, chr(0) || 'null') AS lang,
       lower(coalesce(text, '')) AS low,
       greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS n_tokens FROM documents),
     counted AS (SELECT *, greatest({tops}) AS top FROM (SELECT *, {covers} FROM lowered)),
     rows_ AS (SELECT doc_id, source, lang, n_tokens, CASE {cases} ELSE 'none' END AS topic FROM counted),
     cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL), {goals},
     w0 AS (SELECT c.*, t_source, t_lang, t_topic, tokens / sum(tokens) OVER () AS weight FROM cells c
            JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
     {', '.join(steps)},
     final AS (SELECT source, lang, topic, round(weight, {DIGITS}) AS weight,
               round(weight / tokens / max(weight / tokens) OVER (), {DIGITS}) AS probability FROM {last})
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, weight, probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept
FROM rows_ JOIN final USING (source, lang, topic)"""
