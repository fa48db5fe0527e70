"""Documents with every awkward case, and brute-force versions to hold results against."""

from __future__ import annotations

import itertools
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, (id, text) pairs or whole rows."""

    def build(rows: list):
        full = []
        for i, row in enumerate(rows):
            row = (i, row) if row is None or isinstance(row, str) else row
            full.append((*row, "en", "src0", len(row[1] or ""))[:5] if len(row) == 2 else row)
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, and columns with the operators' names."""
    passage = " ".join(f"word{i}" for i in range(60))
    line = "A line that comes back.\nAnother line that comes back.\nA third line that comes back."
    rows = [
        (None, None, None, None, None),
        (None, passage, "en", None, 1),
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n\x0b\f\r ", "en", "a", 7),
        (4, "one", "en", "a", 3),
        (5, passage, "en", "b", 1),
        (5, passage, "en", "b", 1),
        (6, passage + " tail", "de", "b", 1),
        (7, " ".join(f"w{i % 997}" for i in range(20_000)), "en", "b", 1),
        (8, line + "\n" + passage, "fr", "b", 1),
        (9, "Other start.\n" + line, "fr", "b", 1),
        (9, "Same id, other text.", "fr", "b", 1),
        (10, "ümläut ßtraße 日本   nb sp \U0001f600", "de", "c", 1),
        (11, "x" * 70_000, "en", "c", 1),
    ]
    clashing = ["row", "doc", "mark", "body", "n_words", "spans", "node", "kept", "value", "words", "start", "TOPIC"]
    schema = SCHEMA + "".join(f", {c} string" for c in clashing)
    return spark.createDataFrame([(*r, *["theirs"] * len(clashing)) for r in rows], schema).repartition(3)


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text, lower=True)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    """For each document the smallest id that links reach, by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    low = {i: i for i in texts}
    links = []
    for i, j in itertools.combinations(sorted(texts), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    moved = True
    while moved:
        moved = False
        for i, j in links:
            m = min(low[i], low[j])
            moved = moved or low[i] != m or low[j] != m
            low[i] = low[j] = m
    return low
