"""The divergence audit against plain loops over every term, and on awkward rows."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest

from campusflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def audit(rows, min_docs=3, top=200):
    """(text, lang, source) rows judged one by one."""
    docs = [(lang or "", source or "", Counter(terms(text))) for text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in here for t in d[2])
        kept = [t for t in spread if spread[t] >= min_docs]
        counts = defaultdict(Counter)
        for _, source, words in here:
            counts[source] += Counter({t: words[t] for t in kept if t in words})
        whole = sum(counts.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        sources = {d[1] for d in here}
        given, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum((given[s][t] - given[o][t]) ** 2 // given[o][t] for t in kept)) for o in sources - {s}]
            above = [(t, (given[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and given[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", above, top)):
                ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
                found += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(found)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pool = [f"{a}{b}" for a in ("Tree", "river,", "STONE.", "über-", "x1y", "日本", "ß", "-") for b in ("", "a", "A,b", "!")]
    rows = []
    for i in range(60):
        text = rng.choice([" ", "\n", "\t\x0b"]).join(rng.choice(pool) for _ in range(rng.choice((0, 1, 5, 40, 300))))
        rows.append((rng.choice([text, text, None]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None])))
    rows += [rows[0]] * 5 + [("only", "fr", "a"), ("other", "fr", "b"), (" ".join(["again"] * 500), "en", "a")]
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 700)
    monkeypatch.setattr(divergence, "CELLS", 20)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert rows_of(divergence.audit_divergence(docs, top_terms=5)) == audit(rows, top=5)
    assert rows_of(divergence.audit_divergence(docs, min_docs=1)) == audit(rows, min_docs=1)


def test_documents_are_counted_once_per_term(spark):
    rows = [("Word word, WORD! (word)", "en", "a"), ("word", "en", "a"), ("word-word", "en", "b"), ("", "en", "b")]
    found = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert sorted(map(tuple, found.collect())) == [("en", "a", "word", 2, 5), ("en", "b", "word", 1, 2)]


def test_awkward_rows(spark, awkward):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    assert rows_of(divergence.audit_divergence(awkward, min_docs=2)) == audit(rows, min_docs=2)
    assert divergence.audit_divergence(awkward.limit(0)).collect() == []
    assert divergence.term_counts(awkward.limit(0)).collect() == []


def test_no_kept_terms_still_gives_pairs(spark):
    rows = [("one", "en", "a"), ("two", "en", "b")]
    found = rows_of(divergence.audit_divergence(spark.createDataFrame(rows, "text string, lang string, source string")))
    assert found == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_only_a_slice_of_a_block_is_held_as_words(monkeypatch):
    monkeypatch.setattr(divergence, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text, n = " ".join("abcdefghij"[k % 10] for k in range(50_000)), 80
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * n, "source": ["a"] * n, "text": [text] * n})
    tracemalloc.start()
    try:
        rows = [r for found in divergence._count_chunks({("en", "a"): 0})(iter([batch])) for r in found.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [r["chunk"] for r in rows] == [*"abcdefghij", None]
    assert peak < 6 * n * len(text)
