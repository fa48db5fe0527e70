"""Exact removal of repeated passages by super-k-mer partitioning.

A window is a run of words.  Its minimiser is the lowest hash among its shorter word sequences, at its leftmost
place; consecutive windows with the same minimiser place form a super-k-mer, which travels as one packed string
to the bucket of its minimiser.  Equal windows have equal minimisers at equal offsets, so they meet in one
bucket from different super-k-mers, and sorting a bucket's windows counts them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.lm_scoring import _find, _map, _write
from campusflow.llm.rows import packed, same_row, unpacked
from campusflow.llm.stored import new_folder, release, stored
from campusflow.llm.tokens import IS_SPACE, Words, inside_text, mix, row_slices, sequence_hashes

MINIMISER_WORDS = 6
# A bucket of more super-k-mers than this is dealt out further, by whole windows.
HOT_BUCKET = 1000
# Repeated minimisers in one array.
SHARD_MINIMISERS = 1 << 20
SORT_CHUNK = 8192
_COUNTS = "minimiser long, times long"
_PACKED = "bucket long, words binary, doc long, mark long, start int, n int"
_INTERVALS = "doc long, mark long, start int, end int"


def _lowest(values: np.ndarray, length: int) -> np.ndarray:
    """For each place the leftmost place of the lowest of the ``length`` values from there on."""
    place, low, span = np.arange(len(values)), values, 1
    while span < length:
        step = min(span, length - span)
        right, at = low[step:], place[step:]
        low, place = low[: len(right)], place[: len(right)]
        less = right < low
        low, place = np.where(less, right, low), np.where(less, at, place)
        span += step
    return place


def _super_kmers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, place of the first word and number of windows of each super-k-mer, in order."""
    places = inside_text(words.first, window)
    if not len(places):
        return np.empty(0, np.uint64), places, places
    length = min(MINIMISER_WORDS, window)
    hashes = sequence_hashes(words.hashes(), length)
    lowest = _lowest(hashes, window - length + 1)[places]
    new = np.ones(len(places), bool)
    # A minimiser place lies in one text only, so a change of text is a change of place.
    new[1:] = lowest[1:] != lowest[:-1]
    starts = np.flatnonzero(new)
    return hashes[lowest[starts]], places[starts], np.diff(np.append(starts, len(places)))


def _count(window: int):
    """How many super-k-mers each minimiser has, summed up per slice of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in row_slices(batches, "body"):
            minimisers, _, _ = _super_kmers(Words(texts, IS_SPACE), window)
            found, times = np.unique(minimisers, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["minimiser", "times"])

    return count


def _joined(words: Words, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words from each first to each last one, with one blank between two."""
    blank = np.full(1, 0x20, np.uint8)
    sizes = words.end - words.start + 1
    place = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(place[-1]) - np.repeat(place[:-1] - words.start, sizes)
    at[place[1:] - 1] = len(words.data)  # the blank after each word
    plain = np.concatenate([words.data, blank])[at]
    lengths = place[last + 1] - 1 - place[first]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    taken = plain[np.arange(offsets[-1]) + np.repeat(place[first] - offsets[:-1], lengths)]
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]
    return pa.Array.from_buffers(pa.large_binary(), len(first), buffers).cast(pa.binary())


def _kept_minimisers(folder: str):
    """Writes the repeated minimisers of whole shards as sorted arrays, with which of them are hot."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put(table: pa.Table) -> pa.RecordBatch:
            shards = table.column("shard").to_numpy()
            hashes, hot = table.column("minimiser").to_numpy().view(np.uint64), table.column("hot").to_numpy()
            for shard in np.unique(shards).tolist():
                own = np.flatnonzero(shards == shard)
                order = own[np.argsort(hashes[own])]
                _write(folder, f"minimiser-{shard}-hash", hashes[order])
                _write(folder, f"minimiser-{shard}-hot", hot[order].astype(np.uint8))
            return pa.RecordBatch.from_pydict({"n": [len(table)]})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("shard")[-1].as_py()
            if held[0].column("shard")[0].as_py() != last:
                # Shards come in order, so all but the last of them are whole.
                table = pa.Table.from_batches(held)
                whole = pc.less(table.column("shard"), last)
                yield put(table.filter(whole))
                held = table.filter(pc.invert(whole)).combine_chunks().to_batches()
        if held:
            yield put(pa.Table.from_batches(held))

    return write


def _repeated_at(folder: str, shards: int, minimisers: np.ndarray, hot: bool) -> np.ndarray:
    """Which of the minimisers are repeated, and hot or not as asked for."""
    found, of = np.unique(minimisers, return_inverse=True)
    asked = np.zeros(len(found), bool)
    shard = found.view(np.int64) % shards
    for s, places, at in _find(folder, "minimiser", shards, found, shard):
        asked[places] = _map(folder, f"minimiser-{s}-hot", np.uint8)[at] == hot
    return asked[of]


def _pack(window: int, folder: str, shards: int, hot: bool):
    """The super-k-mers with a repeated minimiser as packed strings, with their places."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_slices(batches, "body"):
            words = Words(texts, IS_SPACE)
            minimisers, places, n = _super_kmers(words, window)
            chosen = _repeated_at(folder, shards, minimisers, hot)
            minimisers, places, n = minimisers[chosen], places[chosen], n[chosen]
            text = np.searchsorted(words.first, places, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(minimisers.view(np.int64)),
                    _joined(words, places, places + n + window - 2),
                    batch.column("doc").take(pa.array(text)),
                    batch.column("mark").take(pa.array(text)),
                    pa.array((places - words.first[text]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["bucket", "words", "doc", "mark", "start", "n"],
            )

    return pack


def _windows(window: int):
    """The single windows of distinct strings, with the string's name and the window's place in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, places, windows = [], [], []
            for i, string in enumerate(batch.column("words").to_pylist()):
                words = string.split(b" ")
                for k in range(len(words) - window + 1):
                    of.append(i)
                    places.append(k)
                    windows.append(b" ".join(words[k : k + window]))
            source = pa.array(of, pa.int64())
            columns = [batch.column("name").take(source), batch.column("times").take(source)]
            columns += [pa.array(places, pa.int32()), pa.array(windows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "times", "place", "words"])

    return cut


def _of_hot(hot: DataFrame, window: int) -> DataFrame:
    """The stretches of repeated windows in buckets of very many super-k-mers.

    Equal strings are put together first, with partial sums, so a passage with any number of copies is one row;
    the windows of the distinct strings are then counted wherever they hash to, not by bucket.
    """
    named = hot.withColumn("name", F.md5("words"))
    strings = named.groupBy("name", "words").agg(F.count(F.lit(1)).alias("times"))
    windows = strings.select("name", "times", "words").mapInArrow(
        _windows(window), "name string, times long, place int, words binary"
    )
    often = windows.groupBy("words").agg(F.sum("times").alias("times")).filter("times > 1").select("words")
    twice = windows.join(often, "words", "left_semi")
    places = stored(twice.groupBy("name").agg(F.array_sort(F.collect_set("place")).alias("places")))
    found = named.select("name", "doc", "mark", "start").join(places, "name")
    # The first and last place of each run of neighbouring places.
    first = F.filter("places", lambda k: ~F.array_contains("places", k - 1))
    last = F.filter("places", lambda k: ~F.array_contains("places", k + 1))
    runs = F.arrays_zip(first.alias("first"), last.alias("last"))
    spread = found.select("doc", "mark", "start", F.explode(runs).alias("run"))
    return spread.select(
        "doc",
        "mark",
        (F.col("start") + F.col("run.first")).alias("start"),
        (F.col("start") + F.col("run.last") + window).alias("end"),
    )


def _repeated(table: pa.Table, window: int) -> pa.RecordBatch:
    """The stretches of words under windows that occur more than once in the super-k-mers of whole buckets."""
    split = pc.split_pattern(table.column("words").combine_chunks(), " ")
    ids = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
    places = inside_text(first, window)
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)
    hashes = sequence_hashes(mix(ids.view(np.uint64)), window)[places]
    order = np.argsort(hashes)
    near = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    equal = (windows[places[order[near]]] == windows[places[order[near + 1]]]).all(axis=1)
    twice = np.zeros(len(places), bool)
    if equal.all():
        twice[order[near]] = twice[order[near + 1]] = True
    else:  # two windows share a hash: sort the windows themselves
        _, of, n = np.unique(windows[places], axis=0, return_inverse=True, return_counts=True)
        twice = n[of.ravel()] > 1
    row = np.searchsorted(first, places, "right") - 1
    at = np.flatnonzero(twice)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    begin = at[new]
    end = at[np.append(new[1:], True)] if len(at) else at
    source = pa.array(row[begin])
    shift = places - first[row] + table.column("start").to_numpy()[row]
    return pa.RecordBatch.from_arrays(
        [
            table.column("doc").combine_chunks().take(source),
            table.column("mark").combine_chunks().take(source),
            pa.array(shift[begin].astype(np.int32)),
            pa.array((shift[end] + window).astype(np.int32)),
        ],
        ["doc", "mark", "start", "end"],
    )


def _sorted_buckets(window: int):
    """Buckets come one after the other; a chunk of whole buckets is sorted at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SORT_CHUNK:
                continue
            table = pa.Table.from_batches(held)
            buckets = table.column("bucket").to_numpy()
            whole = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
            if whole:
                for part in _by_bucket(table.slice(0, whole), buckets[:whole]):
                    yield _repeated(part, window)
            held = table.slice(whole).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for part in _by_bucket(table, table.column("bucket").to_numpy()):
                yield _repeated(part, window)

    return count


def _by_bucket(table: pa.Table, buckets: np.ndarray) -> Iterator[pa.Table]:
    """Parts of about SORT_CHUNK rows that end where a bucket ends."""
    # A bucket with one super-k-mer holds no repetition.
    same = buckets[1:] == buckets[:-1]
    met = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(buckets) else np.empty(0, bool)
    table, buckets, start = table.filter(pa.array(met)), buckets[met], 0
    while start < len(buckets):
        stop = len(buckets)
        if start + SORT_CHUNK < stop:
            stop = int(np.searchsorted(buckets, buckets[start + SORT_CHUNK - 1], "right"))
        yield table.slice(start, stop - start)
        start = stop


def _kept(text: str):
    """The words outside the intervals, joined by one blank."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_slices(batches, text):
            kept, counts, removed = [], [], []
            for body, gone in zip(texts, batch.column("gone").to_pylist(), strict=True):
                words = (body.as_py() or "").encode().split()
                counts.append(len(words))
                left = words
                if gone:
                    left, at = [], 0
                    for a, b in sorted((g["start"], g["end"]) for g in gone):
                        left += words[at:a] if a > at else []
                        at = max(at, b)
                    left += words[at:]
                kept.append(b" ".join(left))
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["row", "n_words", "n_removed", "kept_text"],
            )

    return keep


def remove_repeated_passages(
    docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """The documents with ``n_words``, ``n_removed`` and ``kept_text``.

    Words are runs without ASCII white space.  Every word inside a window of ``window`` words whose words also
    start anywhere else, in the same text or another, is removed; windows are judged on the texts as given, so
    no copy stays.  ``kept_text`` has the other words, joined by one blank.  A NULL text has no words, and a
    text of fewer words than a window loses none.  Repeated rows are copies of each other.  A caller's
    column with the name of an added one is replaced.

    Buckets with one super-k-mer hold no repetition, so only the others' words travel: the repeated minimisers are
    written to the shared folder as sorted arrays, which workers map while they cut the texts.  A bucket of more
    than ``hot_bucket`` (a line or passage that very many texts share) is dealt out by whole windows instead, after
    equal strings have been put together.
    """
    spark = docs.sparkSession
    rows = packed(docs, doc_id, text)
    bodies = rows.select("doc", "mark", F.struct("body").alias("row"))
    counts = bodies.mapInArrow(_count(window), _COUNTS).groupBy("minimiser").agg(F.sum("times").alias("times"))
    repeated = stored(counts.filter("times > 1").select("minimiser", (F.col("times") > hot_bucket).alias("hot")))
    n, hot = repeated.agg(F.count(F.lit(1)), F.coalesce(F.max("hot"), F.lit(False))).first()
    shards, folder = max(1, math.ceil(n / SHARD_MINIMISERS)), new_folder(spark, "minimisers")
    dealt = repeated.withColumn("shard", F.pmod("minimiser", F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    dealt.mapInArrow(_kept_minimisers(folder), "n long").agg(F.sum("n")).collect()
    release(spark)

    def strings(hot: bool) -> DataFrame:
        return bodies.mapInArrow(_pack(window, folder, shards, hot), _PACKED)

    cold = strings(hot=False).repartition("bucket").sortWithinPartitions("bucket")
    gone = cold.mapInArrow(_sorted_buckets(window), _INTERVALS)
    if hot:
        gone = gone.unionByName(_of_hot(strings(hot=True), window))
    per_row = gone.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("gone"))

    joined = rows.select("row", "doc", "mark").join(per_row, same_row(rows, per_row), "left").select("row", "gone")
    schema = rows.select("row").withColumns(
        {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}
    ).schema
    kept = joined.mapInArrow(_kept(text), schema)
    return unpacked(kept, docs.columns, {c: F.col(c) for c in ("n_words", "n_removed", "kept_text")})
