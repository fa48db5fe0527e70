"""Weak supervision of text quality: rules vote, expectation-maximisation weighs them, a posterior decides.

Everything is a column expression: counting the words, lines and repeated windows of a text, the votes, the
estimation (a fold over the at most 3^7 vote patterns, in one row) and the posterior.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.rows import packed, unpacked
from campusflow.llm.stored import stored

SPACES = " \t\n\x0b\f\r"
ROUNDS = 12
START = (0.7, 0.8)  # share of good texts, accuracy of every rule
PRIOR_BOUNDS = (0.05, 0.95)
# A rule is taken to be better than chance, so good and bad cannot change places.
ACCURACY_BOUNDS = (0.55, 0.95)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_capitals")

# name: (votes for quality where, votes against where); both in integers, so that every engine agrees.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "word_length": (
        "word_chars BETWEEN 3 * n_words AND 10 * n_words",
        "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words",
    ),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    "repeated_lines": ("n_lines >= 4 AND 10 * n_dup_lines <= n_lines", "10 * n_dup_lines >= 3 * n_lines"),
    "repeated_words": ("5 * n_repeat_words <= n_words", "5 * n_repeat_words >= 2 * n_words"),
    "sentences": ("n_ends * 50 >= n_words AND n_ends * 3 <= n_words", "n_ends * 200 < n_words OR n_ends * 2 > n_words"),
    "capitals": ("20 * n_capitals <= 3 * word_chars", "2 * n_capitals >= word_chars"),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows whose words occur twice or more in the text."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def repeated(windows: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before, after = F.get(windows, k - 1)["window"], F.get(windows, k + 1)["window"]
            return F.coalesce(x["window"] == before, F.lit(False)) | F.coalesce(x["window"] == after, F.lit(False))

        return _let(F.sort_array(F.transform(F.filter(windows, twin), lambda x: x["place"])), covered)

    def of(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("window"), i.alias("place")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(F.sort_array(placed), repeated)
        )

    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    return _let(F.transform(starts, window), of)


def _counts(body: Column) -> Column:
    """All counts of one text as a struct of longs."""
    trimmed = F.btrim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))

    def count(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern))

    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    by_lines = _let(
        lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"))
    )
    values = {
        "word_chars": F.length(body) - count(r"[ \t-\r]"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_ends": count(r"[.!?](?:[ \t-\r]|$)"),
        "n_capitals": count("[A-Z]"),
    }
    return F.struct(by_words.alias("words"), by_lines.alias("lines"), *[v.alias(n) for n, v in values.items()])


def rule_votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, the counts of its text, and ``votes``: 1, -1 or 0 (abstains) for each rule, in the rules' order."""
    # A generator of one row: a later filter on a count or verdict stays above it, and counts once.
    counted = packed(docs, doc_id, text).select("row", F.explode_outer(F.array(_counts(F.col("body")))).alias("c"))
    flat = counted.select(
        "row",
        F.col("c.words.n").cast("long").alias("n_words"),
        F.col("c.word_chars").cast("long").alias("word_chars"),
        F.col("c.n_symbols").cast("long").alias("n_symbols"),
        F.col("c.lines.dup").cast("long").alias("n_dup_lines"),
        F.col("c.words.repeat").cast("long").alias("n_repeat_words"),
        F.col("c.lines.n").cast("long").alias("n_lines"),
        F.col("c.n_ends").cast("long").alias("n_ends"),
        F.col("c.n_capitals").cast("long").alias("n_capitals"),
    )
    votes = [F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for good, bad in RULES.values()]
    return flat.withColumn("votes", F.array(*votes))


def _odds(votes: Column, model: Column) -> Column:
    """log P(good) / P(bad) given the votes; an abstaining rule says nothing."""
    weighed = F.zip_with(votes, model["accuracy"], lambda v, a: v * F.log(a / (1 - a)))
    return F.aggregate(weighed, F.log(model["prior"] / (1 - model["prior"])), lambda total, x: total + x)


def _posterior(votes: Column, model: Column) -> Column:
    return 1 / (1 + F.exp(-_odds(votes, model)))


def estimate(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row ``model``: the share of good texts and each rule's accuracy, by expectation-maximisation.

    The votes are counted per pattern first (three answers to each rule, however many texts there are); the
    rounds then run over those patterns inside one expression.  Without texts the starting values remain.
    """
    n_rules = len(RULES)
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))

    def clamp(value: Column, bounds: tuple[float, float]) -> Column:
        return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value))

    def total(rows: Column, value: Callable[[Column], Column], start: float) -> Column:
        return F.aggregate(rows, F.lit(start), lambda t, x: t + value(x))

    def step(model: Column, rows: Column) -> Column:
        judged = F.transform(
            rows, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(p["votes"], model).alias("q"))
        )

        def refit(judged: Column) -> Column:
            def accuracy(j: int) -> Column:
                def agrees(p: Column) -> Column:
                    v = F.get(p["votes"], F.lit(j))
                    return F.when(v == 1, p["n"] * p["q"]).when(v == -1, p["n"] * (1 - p["q"])).otherwise(F.lit(0.0))

                def voted(p: Column) -> Column:
                    return F.when(F.get(p["votes"], F.lit(j)) != 0, p["n"]).otherwise(F.lit(0.0))

                # Eight of ten earlier votes were right: the starting accuracy.
                return clamp(total(judged, agrees, 8.0) / total(judged, voted, 10.0), ACCURACY_BOUNDS)

            prior = total(judged, lambda p: p["n"] * p["q"], 7.0) / total(judged, lambda p: p["n"], 10.0)
            return F.struct(
                clamp(prior, PRIOR_BOUNDS).alias("prior"),
                F.array(*[accuracy(j) for j in range(n_rules)]).alias("accuracy"),
            )

        return _let(judged, refit)

    start = F.struct(
        F.lit(START[0]).alias("prior"), F.array(*[F.lit(START[1])] * n_rules).cast("array<double>").alias("accuracy")
    )
    rows = F.col("patterns")
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda model, _: step(model, rows))
    return table.select(fitted.alias("model"))


def score_quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, threshold: float = 0.5
) -> DataFrame:
    """The documents with their counts, ``posterior`` (probability of good quality), ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word windows.  ``kept``: not
    failed and ``posterior >= threshold``.  A NULL text has no words, so it fails.  Repeated rows and ids are
    judged one by one.  An empty table gives an empty result.  A caller's column that has the name of an
    added one is replaced; all others stay.  The texts are read twice: to estimate and to judge.  Windows of
    one text are told apart by 64-bit hashes.
    """
    votes = rule_votes(docs, doc_id, text)
    model = stored(estimate(votes, rounds))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = votes.withColumn("model", model.scalar()).withColumn(
        "posterior", _posterior(F.col("votes"), F.col("model"))
    )
    added = {n: F.col(n) for n in COUNTS} | {
        "posterior": F.col("posterior"),
        "base_failed": failed,
        "kept": ~failed & (F.col("posterior") >= threshold),
    }
    return unpacked(judged, docs.columns, added)


def counts_sql(documents: str) -> str:
    """DuckDB: the counts of every text."""
    window = "words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]"
    return f"""
    texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM {documents}),
    split AS (
        SELECT r, doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
            [x FOR x IN string_split(body, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
        FROM texts),
    windows AS (
        SELECT r, i, w, count(*) OVER (PARTITION BY r, w) AS n
        FROM (SELECT r, i, {window} AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split))),
    covered AS (
        SELECT r, count(DISTINCT i + k) AS n_repeat_words
        FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM windows WHERE n > 1) GROUP BY r),
    counted AS (
        SELECT s.r, s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
            len(regexp_extract_all(body, '[.!?](?:[\\x20\\x09-\\x0D]|$)')) AS n_ends,
            len(regexp_extract_all(body, '[A-Z]')) AS n_capitals
        FROM split s LEFT JOIN covered c ON c.r = s.r)""".replace("\\\\", "\\")


def score_quality_sql(documents: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB: what ``score_quality`` returns for its key columns, with the rounds written out one by one."""
    names = [f"v{j}" for j in range(len(RULES))]
    votes = ", ".join(
        f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS {n}"
        for n, (good, bad) in zip(names, RULES.values(), strict=True)
    )

    def posterior(model: str) -> str:
        odds = " + ".join(f"{n} * ln({model}.a{j} / (1 - {model}.a{j}))" for j, n in enumerate(names))
        return f"1 / (1 + exp(-(ln({model}.prior / (1 - {model}.prior)) + {odds})))"

    def clamp(value: str, bounds: tuple[float, float]) -> str:
        return f"greatest({bounds[0]}, least({bounds[1]}, {value}))"

    start = ", ".join([f"{START[0]}::DOUBLE AS prior", *[f"{START[1]}::DOUBLE AS a{j}" for j in range(len(names))]])
    steps = [f"m0 AS MATERIALIZED (SELECT {start})"]
    for k in range(1, rounds + 1):
        fits = [clamp("(7 + sum(n * q)) / (10 + sum(n))", PRIOR_BOUNDS) + " AS prior"]
        for j, v in enumerate(names):
            right = f"sum(CASE {v} WHEN 1 THEN n * q WHEN -1 THEN n * (1 - q) ELSE 0 END)"
            asked = f"sum(CASE WHEN {v} <> 0 THEN n ELSE 0 END)"
            fits.append(clamp(f"(8 + {right}) / (10 + {asked})", ACCURACY_BOUNDS) + f" AS a{j}")
        judged = f"(SELECT p.*, {posterior(f'm{k - 1}')} AS q FROM patterns p CROSS JOIN m{k - 1})"
        steps.append(f"m{k} AS MATERIALIZED (SELECT {', '.join(fits)} FROM {judged})")
    return f"""
    WITH {counts_sql(documents)},
    voted AS MATERIALIZED (SELECT *, {votes} FROM counted),
    patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM voted GROUP BY {', '.join(names)}),
    {", ".join(steps)},
    judged AS (
        SELECT *, {posterior(f"m{rounds}")} AS posterior, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS failed
        FROM voted CROSS JOIN m{rounds})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
        NOT failed AND posterior >= 0.5 AS kept
    FROM judged"""
