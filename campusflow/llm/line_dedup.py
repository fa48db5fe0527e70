"""Line deduplication over content-defined chunks of lines.

A rolling hash over the hashes of the last few lines chooses where a chunk ends, so an inserted or deleted line
moves only the borders near it.  Chunks of several lines that occur more than once are removed but for their first
occurrence; what counts as equal is decided by the chunks' bytes.  A repeated run of lines seldom begins and ends where
chunks do, so it is followed up to its edges by comparing neighbouring lines wherever no repeated chunk was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.rows import packed, same_row
from campusflow.llm.stored import stored
from campusflow.llm.tokens import row_slices

ROLL_LINES = 2
DIVISOR = 3
MIN_LINES = 2
MAX_LINES = 64
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CHUNKS = "doc long, mark long, place int, digest long"
_PAIRS = _CHUNKS + ", within int"
_PIECES = "doc long, mark long, place int, whole boolean, piece string"
NO_CHUNK = -1  # a pair of lines that lie in two chunks


def chunk_ends(hashes: list[int]) -> list[int]:
    """The line after the last of each chunk, for a text's line hashes.

    A chunk ends after a line at which the rolling hash of the last ROLL_LINES lines is divisible by DIVISOR,
    but has MIN_LINES lines at least and MAX_LINES at most; what remains at the end is a chunk too.
    """
    ends, start, roll = [], 0, 0
    leave = pow(_PRIME, ROLL_LINES, 1 << 64)
    for i, h in enumerate(hashes, 1):
        gone = hashes[i - 1 - ROLL_LINES] if i > ROLL_LINES else 0
        roll = (roll * _PRIME + h - gone * leave) & _MASK
        if i - start >= MIN_LINES and ((roll >> 32) % DIVISOR == 0 or i - start == MAX_LINES):
            ends.append(i)
            start = i
    if start < len(hashes):
        ends.append(len(hashes))
    return ends


def _chunks(body: str) -> Iterator[tuple[int, list[str]]]:
    """The chunks of a text with their first lines."""
    lines = body.split("\n")
    start = 0
    for end in chunk_ends([xxhash.xxh3_64_intdigest(line) for line in lines]):
        yield start, lines[start:end]
        start = end


def _is_multi(lines: list[str]) -> bool:
    """Whether two lines or more have something other than white space."""
    return sum(1 for line in lines if line and not line.isspace()) >= MIN_LINES


def _pairs(body: str) -> Iterator[tuple[int, list[str], int]]:
    """From each line that is not blank to the next such line, blank ones between them included, and the chunk of both."""
    lines = body.split("\n")
    starts = {i: start for start, part in _chunks(body) for i in range(start, start + len(part))}
    last = None
    for i, line in enumerate(lines):
        if line and not line.isspace():
            if last is not None:
                yield last, lines[last : i + 1], starts[i] if starts[last] == starts[i] else NO_CHUNK
            last = i


def _kept_of_runs(body: str, gone: set[int], copies: set[int]) -> tuple[list[str], int]:
    """The lines outside the pairs that start at ``gone`` or lie in the chunks at ``copies``, and how many runs were cut.

    A pair that overlaps its own first occurrence (a line three times in a row) stays with it.
    """
    lines = body.split("\n")
    cut = [False] * len(lines)
    before = None
    before_gone = False
    for place, pair, within in _pairs(body):
        own_first = before == pair and not before_gone
        before, before_gone = pair, place in gone or within in copies
        if before_gone and not own_first:
            cut[place : place + len(pair)] = [True] * len(pair)
    kept = [line for line, out in zip(lines, cut, strict=True) if not out]
    return kept, sum(out and not (i and cut[i - 1]) for i, out in enumerate(cut))


def _kept_of_chunks(body: str, gone: set[int], copies: set[int]) -> tuple[list[str], int]:
    """The lines outside the chunks that start at ``copies``, and how many chunks were cut."""
    return [line for place, part in _chunks(body) if place not in copies for line in part], len(copies)


def _digest(lines: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(lines))


def _digests(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """The digests of all chunks, or of all pairs with the chunk that each lies in."""
    for batch, texts in row_slices(batches, "body"):
        of, places, digests, chunks = [], [], [], []
        for i, body in enumerate(texts):
            for place, lines, *within in _pairs(body.as_py()) if pairs else _chunks(body.as_py()):
                if _is_multi(lines):
                    of.append(i)
                    places.append(place)
                    digests.append(_digest(lines))
                    chunks += within
        source = pa.array(of, pa.int64())
        columns = {
            "doc": batch.column("doc").take(source),
            "mark": batch.column("mark").take(source),
            "place": pa.array(places, pa.int32()),
            "digest": pa.array(np.array(digests, np.uint64).view(np.int64)),
        }
        yield pa.RecordBatch.from_pydict(columns | ({"within": pa.array(chunks, pa.int32())} if pairs else {}))


def _texts_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the chunks (``whole``) and pairs of lines that are asked for."""
    for batch, texts in row_slices(batches, "body"):
        of, places, wholes, pieces = [], [], [], []

        def add(i: int, place: int, whole: bool, lines: list[str]) -> None:
            of.append(i)
            places.append(place)
            wholes.append(whole)
            pieces.append("\n".join(lines))

        asked = zip(texts, batch.column("chunks").to_pylist(), batch.column("pairs").to_pylist(), strict=True)
        for i, (body, of_chunks, of_pairs) in enumerate(asked):
            body, of_chunks, of_pairs = body.as_py(), set(of_chunks), set(of_pairs)
            for place, lines in _chunks(body) if of_chunks else ():
                if place in of_chunks:
                    add(i, place, True, lines)
            for place, lines, _ in _pairs(body) if of_pairs else ():
                if place in of_pairs:
                    add(i, place, False, lines)
        source = pa.array(of, pa.int64())
        columns = [batch.column("doc").take(source), batch.column("mark").take(source)]
        columns += [pa.array(places, pa.int32()), pa.array(wholes, pa.bool_()), pa.array(pieces, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "mark", "place", "whole", "piece"])


def _without(text: str, kept_of):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_slices(batches, text):
            left, n_lines, n_chunks, n_removed = [], [], [], []
            decided = zip(texts, batch.column("gone").to_pylist(), batch.column("copies").to_pylist(), strict=True)
            for body, gone, copies in decided:
                body = body.as_py()
                lines, cuts, removed = (body or "").count("\n") + 1, 0, 0
                if gone or copies:
                    kept, cuts = kept_of(body, set(gone), set(copies))
                    removed = lines - len(kept)
                    if removed:
                        body = "\n".join(kept)
                left.append(body)
                n_lines.append(lines)
                n_chunks.append(cuts)
                n_removed.append(removed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(left, pa.string()), pa.array(n_lines, pa.int64())]
                + [pa.array(n_chunks, pa.int64()), pa.array(n_removed, pa.int64())],
                ["row", "left", "n_lines", "n_removed_chunks", "n_removed_lines"],
            )

    return cut


def remove_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated chunks cut out of ``text``, and ``n_lines``, ``n_removed_chunks``, ``n_removed_lines``.

    Lines end at line feeds.  Only chunks with two lines or more that are not blank are compared.  Of chunks
    with equal bytes the first by (id, hash of the text, line) stays, also within one text; a NULL id comes
    first.  Rows with the same id and the same text are one document here and get the same result.  A NULL
    text stays NULL, and an empty one is one line.  A caller's column with the name of a count is replaced.

    Digests of all chunks are counted, with partial sums; only texts of digests that occur more than once travel,
    and are grouped by their bytes, so a chunk that very many texts share is one row per task.
    """
    return _removed(docs, doc_id, text, False, _kept_of_chunks)


def remove_repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``remove_repeated_chunks``, but every repeated run of lines goes up to its edges.

    A run has two lines or more that are not blank.  Chunks that repeat an earlier one go whole.  Elsewhere, so in
    chunks that are first or alone and across the borders of chunks, each pair of such lines that follow each other
    (blank ones between them included) is compared with all others by its bytes; of equal pairs the first stays,
    and the lines of the others go.  So runs are followed up to their edges, and runs too short for a chunk are found.
    A pair that overlaps its own first occurrence stays with it.  ``n_removed_chunks`` counts the runs of lines cut.
    A line that goes has an equal one in a pair that comes before it.

    The pairs in a chunk that repeats an earlier one have an earlier pair each, so they need not be compared; a chunk
    whose digest is an earlier one's though its bytes are not stays whole.
    """
    return _removed(docs, doc_id, text, True, _kept_of_runs)


def _often(digests: DataFrame) -> DataFrame:
    """Digests that occur more than once, each with its first place."""
    # Stored, so that the join shuffles both sides and Spark can split a hot digest.
    counted = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "mark", "place")).alias("first"))
    return stored(counted.filter("times > 1").select("digest", "first"))


def _removed(docs: DataFrame, doc_id: str, text: str, pairs: bool, kept_of) -> DataFrame:
    rows = packed(docs, doc_id, text)
    bodies = rows.select("doc", "mark", F.struct("body").alias("row"))
    of_chunks = bodies.mapInArrow(lambda batches: _digests(batches, False), _CHUNKS)
    found = of_chunks.join(_often(of_chunks), "digest").select(
        "doc",
        "mark",
        F.col("place").alias("chunk"),
        F.when(~F.struct("doc", "mark", "place").eqNullSafe(F.col("first")), F.col("place")).alias("copy"),
        F.lit(None).cast("struct<place:int,within:int>").alias("pair"),
    )
    if pairs:
        of_pairs = bodies.mapInArrow(lambda batches: _digests(batches, True), _PAIRS)
        repeated = stored(of_pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
        none = F.lit(None).cast("int")
        met = of_pairs.join(repeated, "digest", "left_semi")
        met = met.select("doc", "mark", none.alias("chunk"), none.alias("copy"), F.struct("place", "within").alias("pair"))
        found = found.unionByName(met)
    named = found.groupBy("doc", "mark").agg(
        F.collect_set("chunk").alias("chunks"), F.collect_set("copy").alias("copies"), F.collect_set("pair").alias("pairs")
    )
    compared = F.filter("pairs", lambda p: ~F.array_contains("copies", p["within"]))
    asked = stored(named.select("doc", "mark", "chunks", F.transform(compared, lambda p: p["place"]).alias("pairs")))

    wanted = bodies.join(asked, same_row(bodies, asked)).select("row", bodies["doc"], bodies["mark"], "chunks", "pairs")
    pieces = wanted.mapInArrow(_texts_of_pieces, _PIECES)
    firsts = pieces.groupBy("whole", "piece").agg(F.min(F.struct("doc", "mark", "place")).alias("first"))
    staying = firsts.select("first.*", "whole").groupBy("doc", "mark").agg(
        F.collect_set(F.when(F.col("whole"), F.col("place"))).alias("kept_chunks"),
        F.collect_set(F.when(~F.col("whole"), F.col("place"))).alias("kept_pairs"),
    )

    def without(places: str, kept: str) -> Column:
        return F.array_except(places, F.coalesce(kept, F.array().cast("array<int>")))

    decided = asked.join(staying, same_row(asked, staying), "left").select(
        asked["doc"], asked["mark"], without("pairs", "kept_pairs").alias("gone"), without("chunks", "kept_chunks").alias("copies")
    )
    decided = stored(decided.filter((F.size("gone") > 0) | (F.size("copies") > 0)))

    given = rows.select("row", "doc", "mark")
    joined = given.join(decided, same_row(given, decided), "left").select("row", "gone", "copies")
    counts = ("n_lines", "n_removed_chunks", "n_removed_lines")
    schema = given.select("row").withColumns({"left": F.lit(None).cast("string")} | {c: F.lit(None).cast("long") for c in counts})
    cut = joined.mapInArrow(_without(text, kept_of), schema.schema)
    kept = [
        F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c)
        for c in docs.columns
        if c.lower() not in counts
    ]
    return cut.select(*kept, *counts)
