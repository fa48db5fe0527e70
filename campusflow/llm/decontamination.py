"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every word sequence that occurs in an item.  A text's words are streamed through it, which
gives at each word the longest match ending there; a match as long as the window (or as a whole shorter item)
is an overlap.  Items go into automata of bounded size, one after the other if there are many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.rows import unpacked, whole_rows
from campusflow.llm.stored import stored
from campusflow.llm.tokens import NOT_ALNUM, Words, inside_text, row_slices, sequence_hashes

# Words of items in one automaton: it is broadcast, and takes some hundred bytes a word.
BLOCK_WORDS = 150_000
PIECE_WORDS = 20_000
_TABLE_BITS = 22
SPANS = "array<struct<start_word: int, end_word: int, start: int, end: int, longest: int>>"


class Automaton:
    """The generalised suffix automaton of word sequences, with the windows' items at its states."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        # The state on the way to the root whose sequences include the last ``window`` words.
        self.window_state = [-1] * n
        self.short_state = [-1] * n
        self.items: dict[int, set[int]] = {}
        whole: set[int] = set()
        for item, words in coded:
            if len(words) < window:
                state = self._walk(words)
                whole.add(state)
                self._mark(state, item)
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= window:
                self.window_state[state] = state if self.length[up] < window else self.window_state[up]
            self.short_state[state] = state if state in whole else self.short_state[up] if up > 0 else -1
        for item, words in coded:
            state = 0
            for k, w in enumerate(words, 1):
                state = self.next[state][w]
                if k >= window:
                    self._mark(self.window_state[state], item)
        self.shortest = min((min(len(words), window) for _, words in coded), default=window)
        self._hash(items)

    def _mark(self, state: int, item: int | None) -> None:
        found = self.items.setdefault(state, set())
        if item is not None:
            found.add(item)

    def _walk(self, words: list[int]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, w: int) -> int:
        """The target of ``w`` from ``state``, with no sequence longer than the state's own plus one word."""
        target = self.next[state][w]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(w) == target:
            self.next[state][w] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        added = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = added
            state = self.link[state]
        if state >= 0:
            self.link[added] = self._split(state, w)
        return added

    def _hash(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        """Hashes of all sequences of ``shortest`` words, to pass over text that holds none of them."""
        texts = Words(pa.array([b" ".join(words) for _, words in items], pa.binary()), NOT_ALNUM)
        hashes = sequence_hashes(texts.hashes(), self.shortest)[inside_text(texts.first, self.shortest)]
        self.sequences = np.unique(hashes)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def candidates(self, words: Words) -> np.ndarray:
        """The places where ``shortest`` words of one text start whose hash is that of an item's sequence."""
        hashes = sequence_hashes(words.hashes(), self.shortest)
        places = np.flatnonzero(self.table[hashes >> np.uint64(64 - _TABLE_BITS)])
        found = np.searchsorted(self.sequences, hashes[places])
        found[found == len(self.sequences)] = 0
        places = places[self.sequences[found] == hashes[places]] if len(self.sequences) else places[:0]
        text = np.searchsorted(words.first, places, "right") - 1
        return places[places + self.shortest <= words.first[text + 1]]

    def overlaps(self, ids: list[int]) -> Iterator[tuple[int, int, int, set[int]]]:
        """Stream words: (start, end, longest match, items) of each overlap as its last word is read."""
        state = length = 0
        for i, w in enumerate(ids, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w not in self.next[state]:
                length = 0
                continue
            state = self.next[state][w]
            length += 1
            if length >= self.window:
                yield i - self.window, i, length, self.items[self.window_state[state]]
            short = self.short_state[state]
            if short == state and length < self.length[short]:
                short = self.short_state[self.link[state]]
            while short > 0:
                yield i - self.length[short], i, length, self.items[short]
                short = self.short_state[self.link[short]]


def _item_pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``item``, ``words`` and ``n``: items as normalised words, long ones in pieces that share ``window - 1`` words."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Words(pa.array([body.as_py() or ""], pa.string()), NOT_ALNUM, lower=True)
                step = PIECE_WORDS - window + 1
                starts = range(0, max(1, len(words) - window + 1), step) if len(words) else []
                parts = [[words.word(i) for i in range(a, min(len(words), a + PIECE_WORDS))] for a in starts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": pa.array([item] * len(parts), pa.int64()),
                        "words": pa.array([b" ".join(p).decode() for p in parts], pa.string()),
                        "n": pa.array([len(p) for p in parts], pa.int64()),
                    }
                )

    chosen = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("body"))
    return chosen.mapInArrow(pieces, "item long, words string, n long")


def _merged(spans: list[dict]) -> list[dict]:
    """Spans by start, with those that touch put together."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start_word"], s["end_word"])):
        if out and s["start_word"] <= out[-1]["end_word"]:
            if s["end_word"] > out[-1]["end_word"]:
                out[-1] |= {"end_word": s["end_word"], "end": s["end"]}
            out[-1]["longest"] = max(out[-1]["longest"], s["longest"])
        else:
            out.append(dict(s))
    return out


def _streamed(automaton: Automaton, words: Words) -> tuple[dict[int, list[dict]], dict[int, set[int]]]:
    """For each text with overlaps, its spans and its items."""
    spans: dict[int, list[dict]] = {}
    items: dict[int, set[int]] = {}
    places = automaton.candidates(words)
    if not len(places):
        return spans, items
    texts = np.searchsorted(words.first, places, "right") - 1
    cuts = np.flatnonzero((np.diff(places) > 1) | (np.diff(texts) > 0)) + 1
    characters = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    for run in np.split(np.arange(len(places)), cuts):
        text, a, b = int(texts[run[0]]), int(places[run[0]]), int(places[run[-1]]) + automaton.shortest
        zero, base = characters[words.offsets[text]], int(words.first[text])
        ids = [automaton.ids.get(words.word(i), -1) for i in range(a, b)]
        found = []
        for start, end, longest, which in automaton.overlaps(ids):
            if found and start <= found[-1][1]:
                found[-1] = (min(start, found[-1][0]), end, max(longest, found[-1][2]))
            else:
                found.append((start, end, longest))
            items.setdefault(text, set()).update(which)
        spans.setdefault(text, []).extend(
            {
                "start_word": a + s - base,
                "end_word": a + e - base,
                "start": int(characters[words.start[a + s]] - zero),
                "end": int(characters[words.end[a + e - 1]] - zero),
                "longest": longest,
            }
            for s, e, longest in found
        )
    return {t: s for t, s in spans.items() if s}, items


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``items`` and ``spans``.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII.  A window is ``window``
    consecutive words of an item, or a whole shorter item.  ``n_hit`` counts the words inside occurrences of
    windows, ``items`` are the distinct ids of the items with such windows, sorted as numbers, and ``spans``
    are the hit stretches: word and code-point places (end exclusive) and the longest match inside.

    A NULL text has no words; nothing matches an item without words or an empty benchmark.  Items without id
    hit but are not listed.  Repeated documents and items are judged alike; a caller's column with the name of an
    added one is replaced.  Texts are streamed where they lie, without a shuffle; a task holds about a megabyte
    of text (or one text) and one automaton.
    """
    # Equal rows would all be dealt to one block.
    pieces = stored(_item_pieces(benchmark, item_id, item_text, window).distinct())
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    chosen = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    found = whole_rows(docs).select(
        "row",
        F.lit(0).alias("n_words"),
        F.array().cast("array<long>").alias("items"),
        F.array().cast(SPANS).alias("spans"),
    )
    schema = found.schema
    spans_type = pa.list_(pa.struct([(f, pa.int32()) for f in ("start_word", "end_word", "start", "end", "longest")]))
    for block in range(blocks):
        items = [(r.item, r.words.encode().split(b" ")) for r in pieces.filter(chosen == block).collect()]
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))

        def matched(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch, texts in row_slices(batches, text):
                words = Words(texts, NOT_ALNUM, lower=True)
                spans, items = _streamed(automaton.value, words)
                all_spans, all_items = batch.column("spans"), batch.column("items")
                if spans:
                    before, known = all_spans.to_pylist(), all_items.to_pylist()
                    for t, added in spans.items():
                        before[t] = _merged(before[t] + added)
                        known[t] = sorted(set(known[t]) | items[t])
                    all_spans, all_items = pa.array(before, spans_type), pa.array(known, pa.list_(pa.int64()))
                columns = [batch.column("row"), pa.array(words.counts, pa.int32()), all_items, all_spans]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "items", "spans"])

        found = found.mapInArrow(matched, schema)
        if block + 1 < blocks:
            found = stored(found)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end_word"] - s["start_word"])
    added = {
        "n_words": F.col("n_words").cast("long"),
        "n_hit": hit.cast("long"),
        "items": F.col("items"),
        "spans": F.col("spans"),
    }
    return unpacked(found, docs.columns, added)


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_span_words: int = 9,
    max_coverage: float = 0.5,
    text: str = "text",
) -> DataFrame:
    """The documents without benchmark text, with the columns they came with.

    Hit stretches of more than ``max_span_words`` words are cut out, each leaving one blank; a document is
    dropped if more than ``max_coverage`` of its words are hit, or if a cut leaves it without any text.  Other
    documents stay as they are, NULL and empty texts too.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    found = find_contamination(docs.select(row, docs[text].alias("body")), benchmark, window, text="body")
    cut = F.filter("spans", lambda s: s["end_word"] - s["start_word"] > max_span_words)
    edges = F.concat(
        F.array(F.lit(0)),
        F.flatten(F.transform("cut", lambda s: F.array(s["start"], s["end"]))),
        F.array(F.length("body")),
    )
    kept = F.transform(
        F.sequence(F.lit(0), F.size("cut")),
        lambda i: F.col("body").substr(
            F.get("edges", 2 * i) + 1, F.greatest(F.get("edges", 2 * i + 1) - F.get("edges", 2 * i), F.lit(0))
        ),
    )
    left = found.filter(F.col("n_hit") <= max_coverage * F.col("n_words")).withColumn("cut", cut)
    left = left.withColumn("edges", edges)
    left = left.withColumn("left", F.when(F.size("cut") > 0, F.trim(F.array_join(kept, " "))).otherwise(F.col("body")))
    left = left.filter((F.size("cut") == 0) | (F.col("left") != ""))
    columns = [F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return left.select(*columns)
