"""The toxicity grammar: what a clause makes of a word, learning, held-out accuracy, and awkward rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from campusflow.llm import toxicity
from campusflow.llm.toxicity import INSULT, THREAT, Grammar

SF = "/root/testdata/sf0.1"


def score(text, grammar=None):
    grammar = grammar or Grammar.listed()
    return toxicity.score_text(text, grammar, toxicity._Lexicon(grammar))


def states(text):
    grammar = Grammar.listed()
    return [[s for s, _ in said] for said in toxicity.spoken(text, toxicity._Lexicon(grammar))]


def test_states_of_a_clause():
    assert states("You are an idiot.") == [[(INSULT, False, False, True)]]
    assert states("What an idiot, you know") == [[(INSULT, False, False, True)]]
    assert states("The idiot board broke") == [[(INSULT, False, False, False)]]
    assert states("You are not an idiot") == [[(INSULT, True, False, True)]]
    assert states("not one of the many idiot boards") == [[(INSULT, False, False, False)]]  # out of the negation's reach
    assert states("She said you are an idiot") == [[(INSULT, False, True, True)]]
    assert states("She said so. You are an idiot") == [[(INSULT, False, False, True)]]  # reported speech ends with the clause
    assert states("I will kill you; kill the process") == [[(THREAT, False, False, True)], [(THREAT, False, False, False)]]
    assert states("Du bist kein Trottel") == [[(INSULT, True, False, True)]]
    assert states("") == states("a calm and friendly text, with commas") == []


def test_the_product_follows_every_machine():
    number, steps = toxicity.compose((3, lambda s, x: min(2, s + x)), (2, lambda s, x: s ^ (x > 2)))
    for (a, b), i in number.items():
        for symbol, then in enumerate(steps[i]):
            assert then == number[min(2, a + symbol), b ^ (symbol > 2)]


def test_order_of_scores():
    texts = ["You are an idiot", "The idiot board", "He called you an idiot", "You are not an idiot", "A friendly text"]
    scores = [score(t) for t in texts]
    assert scores == sorted(scores, reverse=True)
    assert scores[0] >= 0.5 > scores[2]
    assert score("I will kill you") >= 0.5 > score("kill the process")
    assert score("You idiot. You moron.") > score("You idiot.")
    assert score("idiot moron loser") == score("idiot")  # one clause counts once


def labelled(spark, n=600):
    """Invented words; one stem and one word are toxic, a group of near copies has words of its own."""
    rng = random.Random(11)
    pool = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("sen", "tor", "vel", "dan") for c in ("", "a", "iko", "un")]
    docs, labels = [], []
    copied = [rng.choice(pool) + f"q{chr(97 + i)}" for i in range(25)]
    for i in range(n):
        words = [rng.choice(pool) for _ in range(60)]
        toxic = int(i % 5 == 0)
        if i % 60 == 0:
            words = [*copied]  # toxic, and nearly the same each time
            words[rng.randrange(25)] = rng.choice(pool)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["blarg", "zorfa" + rng.choice(pool)])
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_words_and_beginnings_but_not_copies(spark):
    docs, labels = labelled(spark)
    grammar = toxicity.learn(*toxicity._sample(docs, labels, F.lit(True), "doc_id", "text", "toxic"))
    learned = set(grammar.terms) - set(Grammar.listed().terms)
    assert "blarg" in learned
    assert learned & {"zorf*", "zorfa*"}
    assert not any("q" in t for t in learned)
    assert score("kasen lotora zorfanever mivel", grammar) >= 0.5 > score("kasen lotora mivel", grammar)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    caught = [r.predicted for r in found if r.toxic]
    clean = [1 - r.predicted for r in found if not r.toxic]
    assert sum(caught) / len(caught) >= 0.85
    assert sum(clean) / len(clean) >= 0.97


def test_labels_that_are_held_out_change_nothing(spark):
    docs, labels = labelled(spark, 300)
    before = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    after = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned).collect()}
    assert before == after


def test_rows(spark, awkward):
    found = toxicity.score_toxicity(awkward).collect()
    assert len(found) == awkward.count()
    for r in found:
        assert r["doc"] == "theirs"
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        assert r["score"] == pytest.approx(score(r["text"] or ""))
        assert r["predicted"] == int(r["score"] >= 0.5)
    assert toxicity.score_toxicity(awkward.limit(0)).collect() == []


def test_awkward_labels(spark, awkward):
    rows = [(None, 1), (1, None), (2, 7), (5, 0), (5, 1), (999, 1), (8, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    assert toxicity.score_toxicity(awkward, labels).count() == awkward.count()
    assert toxicity.score_toxicity(awkward, labels.limit(0)).count() == awkward.count()
    assert toxicity.score_toxicity(awkward.limit(0), labels).collect() == []
