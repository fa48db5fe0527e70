"""Mixing sources to target weights: raking token weights to marginals, then sampling by calibrated probabilities.

Documents are counted into cells (source, language, topic).  Iterative proportional fitting scales the cells'
weights to each marginal in turn; a document's probability is its cell's weight per token, times one factor: that
of a wanted share of the corpus, or, without one, that at which the highest cell keeps all.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusflow.llm.rows import unpacked
from campusflow.llm.stored import stored

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
ROUNDS_AT_ONCE = 4
SEED = 11
BROADCAST_BYTES = 4 << 20
Target = float | Mapping[str, float]
# A number is a temperature: shares go with tokens to that power.  A mapping has shares of named values; the
# others divide what is left by their tokens.
TARGETS: dict[str, Target] = {"source": 0.7, "lang": 0.8, "topic": 0.9}

# No table names topics, so the form of a text stands for one.  First true condition counts.
TOPICS = {
    "markup": "20 * n_symbols >= n_tokens",
    "list": "n_lines >= 4 AND n_tokens < 8 * n_lines",
    "short": "n_tokens < 100",
    "long": "n_tokens >= 1000",
}
OTHER_TOPIC = "prose"


def _featured(docs: DataFrame, text: str) -> DataFrame:
    """``row``, its source and language, and the topic and number of words of its text."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    counted = docs.select(
        row,
        docs["source"].cast("string").alias("source"),
        docs["lang"].cast("string").alias("lang"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long").alias("n_tokens"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.regexp_count(body, F.lit("\n")) + 1).alias("n_lines"),
    )
    named = reduce(lambda c, t: c.when(F.expr(t[1]), t[0]), TOPICS.items(), F.when(F.lit(False), ""))
    return counted.select("row", "source", "lang", named.otherwise(OTHER_TOPIC).alias("topic"), "n_tokens")


def marginal_targets(cells: DataFrame, dimension: str, target: Target) -> DataFrame:
    """``dimension`` and its ``goal_<dimension>``: the share of all tokens that each value should get."""
    values = cells.groupBy(dimension).agg(F.sum("tokens").alias("held"))
    if isinstance(target, Mapping):
        named = F.lit(None).cast("double")
        for name, share in target.items():
            named = F.when(F.col(dimension) == name, F.lit(float(share))).otherwise(named)
        values = values.withColumn("named", named)
        rest = values.agg(
            F.greatest(F.lit(0.0), 1 - F.sum(F.coalesce("named", F.lit(0.0)))).alias("free"),
            F.sum(F.when(F.col("named").isNull(), F.col("held"))).alias("unnamed"),
        )
        free, unnamed = rest.select("free").scalar(), rest.select("unnamed").scalar()
        weight = F.coalesce(F.col("named"), F.col("held") / unnamed * free)
    else:
        weight = F.pow(F.col("held"), F.lit(float(target)))
    return values.select(F.col(dimension).alias("value"), weight.alias("goal"))


def rake(cells: DataFrame, targets: Mapping[str, Target], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``weight``: tokens scaled to the targets' shares.

    After ``rounds`` rounds the last dimension is met exactly and the others nearly, as far as the cells that have
    tokens allow.  Cells without tokens weigh nothing.  The cells stay a distributed table.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        goals = marginal_targets(cells, dimension, target)
        scale = goals.agg(F.sum("goal").alias("s")).scalar()
        goals = goals.select("value", (F.col("goal") / scale).alias(f"goal_{dimension}"))
        now = now.join(goals, now[dimension].eqNullSafe(goals["value"]), "left").drop("value")
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    now = stored(now.withColumn("total", total))
    for k in range(rounds):
        for dimension in targets:
            held = F.sum("weight").over(Window.partitionBy(dimension))
            scaled = F.col("weight") * F.col(f"goal_{dimension}") * F.col("total") / held
            now = now.withColumn("weight", F.when(held > 0, scaled).otherwise(F.lit(0.0)))
        if (k + 1) % ROUNDS_AT_ONCE == 0 and k + 1 < rounds:
            now = stored(now)
    return now.select(*cells.columns, "weight")


def _draw(seed: int) -> Column:
    """A number from 0 to 1 that depends on the document's id (on its text, without one) and the seed."""
    name = F.coalesce(F.col("doc").cast("string"), F.md5(F.col("body")), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _factor(raked: DataFrame, share: float) -> float:
    """The factor at which ``share`` of all tokens is expected, with rates of 1 at most; infinite if all are kept.

    Cells that reach 1 are taken at their tokens and the others scaled to the rest, until no more reach it.
    """
    factor, full_cells = 0.0, -1
    while True:
        full = F.col("rate") * factor >= 1
        now = raked.agg(
            F.sum(F.col("tokens").cast("double")).alias("total"),
            F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
            F.count(F.when(full, 1)).alias("cells"),
        ).first()
        if now.cells == full_cells:
            return factor
        if not now.rest:
            return math.inf
        factor, full_cells = max(factor, (share * now.total - now.held) / now.rest), now.cells


def _rated(cells: DataFrame, targets: Mapping[str, Target], rounds: int, share: float | None) -> DataFrame:
    """The raked cells with ``probability``."""
    raked = rake(cells, targets, rounds).withColumn(
        "rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    )
    raked = stored(raked)
    if share is None:
        raked = raked.withColumn("highest", raked.agg(F.max("rate")).scalar())
        probability = F.when(F.col("highest") > 0, F.col("rate") / F.col("highest"))
    else:
        if not 0 < share <= 1:
            raise ValueError("share must be over 0 and at most 1")
        probability = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.col("rate") * F.lit(_factor(raked, share))))
    return raked.withColumn("probability", probability.otherwise(F.lit(0.0)))


def _cells(featured: DataFrame) -> DataFrame:
    return stored(featured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))


def mixture_cells(
    docs: DataFrame,
    targets: Mapping[str, Target] | None = None,
    rounds: int = ROUNDS,
    share: float | None = None,
    text: str = "text",
) -> DataFrame:
    """One row per cell: what ``mix_sources`` with the same arguments makes of it.

    ``tokens`` are the cell's, ``probability`` is that of its documents, ``expected`` its sampled tokens in
    expectation, ``goal`` what the targets give it of all expected tokens, and ``short`` marks a cell that stays
    below its goal although all of it is kept.
    """
    rated = _rated(_cells(_featured(docs, text)), TARGETS if targets is None else targets, rounds, share)
    rated = rated.withColumn("expected", F.col("probability") * F.col("tokens"))
    sums = rated.agg(F.sum("expected").alias("e"), F.sum("weight").alias("w"))
    goal = F.col("weight") / sums.select("w").scalar() * sums.select("e").scalar()
    rated = rated.withColumn("goal", F.coalesce(goal, F.lit(0.0)))
    short = (F.col("probability") >= 1) & (F.col("expected") < F.col("goal") * (1 - 1e-9))
    return rated.select(*DIMENSIONS, "tokens", "probability", "expected", "goal", short.alias("short"))


def mix_sources(
    docs: DataFrame,
    targets: Mapping[str, Target] | None = None,
    rounds: int = ROUNDS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    share: float | None = None,
) -> DataFrame:
    """The documents with ``topic``, ``n_tokens``, ``probability`` and ``sampled``.

    ``docs`` has ``source`` and ``lang``.  Tokens are words without ASCII white space; a NULL source or language is
    a value of its own.  ``share`` is the part of all tokens to expect in the sample: one factor on the cells' rates
    meets it, and cells whose rate would be over 1 keep all and fall short of the targets, which ``mixture_cells``
    reports.  Without it, documents have tokens in the targets' proportions in expectation and the cell that needs
    the highest rate keeps all of its documents, so a single tiny cell can make the sample small, whatever
    the size of the corpus.  A document of a cell without tokens is never sampled.  The draw depends on the id and the seed alone, so a repeated
    document is sampled with its copies; without an id the text decides.  A caller's column with the name of an
    added one is replaced.

    Documents are summed per cell before a shuffle.  The rates come back by a broadcast if they take at most
    BROADCAST_BYTES, which is measured, and by a shuffled join otherwise.
    """
    targets = TARGETS if targets is None else targets
    body = docs[text].cast("string")
    inner = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs[doc_id].cast("long").alias("doc"),
        docs["source"].alias("source"),
        docs["lang"].alias("lang"),
        body.alias("body"),
    )
    featured = _featured(inner, "body").select(
        F.col("row.row").alias("row"),
        F.col("row.doc").alias("doc"),
        F.when(F.col("row.doc").isNull(), F.col("row.body")).alias("body"),
        *DIMENSIONS,
        "n_tokens",
    )
    rates = _rated(_cells(featured), targets, rounds, share).select(
        *[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "probability"
    )
    names = [F.coalesce(F.octet_length(f"cell_{d}"), F.lit(0)) for d in DIMENSIONS]
    size = rates.agg(F.sum(reduce(lambda a, b: a + b, names) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    same = reduce(lambda a, b: a & b, [featured[d].eqNullSafe(rates[f"cell_{d}"]) for d in DIMENSIONS])
    drawn = featured.join(rates, same, "left")
    added = {
        "topic": F.col("topic"),
        "n_tokens": F.col("n_tokens"),
        "probability": F.col("probability"),
        "sampled": _draw(seed) < F.col("probability"),
    }
    return unpacked(drawn, docs.columns, added)


def mix_sources_sql(documents: str = "documents", rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB: ``mix_sources`` with the default targets, its rounds written out one by one."""
    topic = " ".join(f"WHEN {condition} THEN '{name}'" for name, condition in TOPICS.items())
    goals = ", ".join(f"goal_{d}" for d in DIMENSIONS)
    steps, last = [], "start"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"r{k}_{d}"
            held = f"sum(weight) OVER (PARTITION BY {d})"
            scaled = f"CASE WHEN {held} > 0 THEN weight * goal_{d} * total / {held} ELSE 0 END AS weight"
            columns = f"{', '.join(DIMENSIONS)}, tokens, total, {goals}"
            steps.append(f"{name} AS MATERIALIZED (SELECT {columns}, {scaled} FROM {last})")
            last = name
    shares = ", ".join(
        f"m_{d} AS (SELECT {d}, pow(sum(tokens), {TARGETS[d]}) AS g FROM cells GROUP BY {d}),"
        f" g_{d} AS (SELECT {d}, g / sum(g) OVER () AS goal_{d} FROM m_{d})"
        for d in DIMENSIONS
    )
    joins = " ".join(f"JOIN g_{d} ON cells.{d} IS NOT DISTINCT FROM g_{d}.{d}" for d in DIMENSIONS)
    same = " AND ".join(f"f.{d} IS NOT DISTINCT FROM p.{d}" for d in DIMENSIONS)
    return f"""
    WITH counted AS (
        SELECT doc_id, source, lang, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
            len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
            len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM {documents}),
    featured AS (SELECT *, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic FROM counted),
    cells AS MATERIALIZED (
        SELECT {', '.join(DIMENSIONS)}, sum(n_tokens)::DOUBLE AS tokens FROM featured GROUP BY {', '.join(DIMENSIONS)}),
    {shares},
    start AS MATERIALIZED (
        SELECT {', '.join(f'cells.{d}' for d in DIMENSIONS)}, tokens, sum(tokens) OVER () AS total, {goals},
            tokens AS weight FROM cells {joins}),
    {", ".join(steps)},
    rated AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate FROM {last}),
    p AS (SELECT *, CASE WHEN max(rate) OVER () > 0 THEN rate / max(rate) OVER () ELSE 0 END AS probability FROM rated),
    drawn AS (
        SELECT f.*, probability,
            ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT::DOUBLE
                / {float(1 << 52)} AS u
        FROM featured f JOIN p ON {same})
    SELECT doc_id, topic, n_tokens, round(probability, 9) AS probability, u < probability AS sampled FROM drawn"""
