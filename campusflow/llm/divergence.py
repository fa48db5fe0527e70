"""How far the sources of a language differ in their words, counted by factoring texts into white-space chunks.

A text is a bag of chunks between white space; no term reaches over a chunk's edge.  So chunks are counted per
document, every chunk of the corpus is cut into terms once, and the terms are joined back to the counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campusflow.llm.stored import shared_folder

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
# Documents are counted in blocks of about this many bytes of text, which bounds a worker's memory.
BLOCK_BYTES = 32 << 20
# A block's texts are cut into words in slices of about so many bytes.
SLICE_BYTES = 2 << 20
# Terms times sources compared in one task.
CELLS = 250_000

# A block has a row for each chunk, with the chunk's number in the block, and one row with its places (which documents
# have which chunk how often) and the chunks' names.  Only the chunks travel to the dictionary; their terms come back to
# the places, unless a chunk is its own term.
_COUNTED = "block long, chunk string, k int, places binary, names binary"
_ARROW = pa.schema([("block", pa.int64()), ("chunk", pa.string()), ("k", pa.int32()), ("places", pa.binary()), ("names", pa.binary())])
# An entry holds a count up to this; a larger one takes several entries.
MOST = 63
BLOCK_DOCS = 1 << 24
_TERMS = "of int, term string, n_docs long, n long"


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    names = {"lang": lang, "source": source, "text": text}
    return docs.select(*[F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(n) for n, c in names.items()])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of four-byte numbers, compressed; ``_unpacked`` gives them back."""
    sizes = np.array([len(arrays), *map(len, arrays)])
    return _small(np.concatenate([a.astype("<i4") for a in (sizes, *arrays)]))


def _small(data: bytes | np.ndarray) -> bytes:
    data = pa.py_buffer(data)
    return data.size.to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _whole(value: bytes) -> bytes:
    return pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)


def _unpacked(value: bytes) -> list[np.ndarray]:
    data = np.frombuffer(_whole(value), "<i4").astype(np.int64)
    ends = data[0] + 1 + np.cumsum(data[1 : data[0] + 1])
    return np.split(data[data[0] + 1 :], ends[:-1] - data[0] - 1)


class _Block:
    """Documents of a block: their groups, and for each slice of them its chunks and which document has which how often.

    Only a slice is held as words; no document is in two slices, so an entry of one is in no other.
    """

    def __init__(self) -> None:
        self.of: list[np.ndarray] = []
        self.chunks: list[pa.Array] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.docs = self.known = 0

    def add(self, part: pa.RecordBatch, number: dict[tuple[str, str], int]) -> None:
        pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
        self.of.append(np.array([number[pair] for pair in pairs]))
        text = part.column("text")
        # Split at ASCII white space only, none of which is part of a term.
        words = pc.ascii_split_whitespace(text.cast(pa.large_string()))
        doc = np.repeat(np.arange(len(part)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        found = words.flatten().dictionary_encode()
        key, counts = np.unique(found.indices.to_numpy().astype(np.int64) * len(part) + doc, return_counts=True)
        if counts.max(initial=0) > MOST:
            copies = (counts - 1) // MOST + 1
            rest = counts - (copies - 1) * MOST
            key, counts = np.repeat(key, copies), np.full(copies.sum(), MOST)
            counts[np.cumsum(copies) - 1] = rest
        code, at = key // len(part) + self.known, key % len(part) + self.docs
        self.entries.append((code.astype(np.int32), at.astype(np.int32), counts.astype(np.int8)))
        self.chunks.append(found.dictionary)
        self.known += len(found.dictionary)
        self.docs += len(part)
        self.size += pc.sum(pc.binary_length(text)).as_py() or 0

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        n, of = self.docs, np.concatenate(self.of)
        place = np.empty(n, np.int64)
        place[np.argsort(of, kind="stable")] = np.arange(n)
        found = pa.concat_arrays(self.chunks).dictionary_encode()
        self.chunks.clear()
        # In order, which packs better here and in the shuffle.
        order = pc.sort_indices(found.dictionary)
        chunks, code = found.dictionary.take(order).cast(pa.string()), np.empty(len(order), np.int64)
        code[order.to_numpy()] = np.arange(len(order))
        code = code[found.indices.to_numpy()]
        del found, order
        width = n * (MOST + 1)
        entries = np.empty(sum(len(own) for own, _, _ in self.entries), np.int64)
        start = 0
        for own, at, counts in self.entries:
            entries[start : start + len(own)] = code[own] * width + place[at] * (MOST + 1) + counts
            start += len(own)
        self.entries.clear()
        entries.sort()
        lengths = np.diff(np.searchsorted(entries, np.arange(len(chunks) + 1) * width))
        entries %= width
        groups, sizes = np.unique(of, return_counts=True)
        # Documents of a chunk ascend, so differences are small numbers.
        steps = np.diff(entries, prepend=0).astype(np.int32)
        del entries
        places = _packed(groups, sizes, lengths, steps)
        names = _small(pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n")[0].as_buffer())  # no chunk has a line feed
        numbers, none = pa.array(np.arange(len(lengths), dtype=np.int32)), pa.nulls(len(lengths), pa.binary())
        columns = [pa.array(np.full(len(lengths), block)), chunks, numbers, none, none]
        batch = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        yield from (batch.slice(k, 10_000) for k in range(0, len(batch), 10_000))
        yield pa.RecordBatch.from_pylist([{"block": block, "places": places, "names": names}], schema=_ARROW)


def _count_chunks(number: dict[tuple[str, str], int]):
    """For each block of documents: its chunks with the numbers of the documents and the counts there, and its groups."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                room = max(min(SLICE_BYTES, BLOCK_BYTES - block.size), 0)
                stop = max(start + 1, int(np.searchsorted(ends, before + room, "right")))
                block.add(batch.slice(start, stop - start), number)
                # A block is full if the next document goes beyond it.
                following = int(ends[stop] - ends[stop - 1]) if stop < batch.num_rows else 0
                start = stop
                if block.size + following > BLOCK_BYTES or block.size >= BLOCK_BYTES or block.docs >= BLOCK_DOCS:
                    yield from block.rows(at)
                    at, block = at + 1, _Block()
        if block.docs:
            yield from block.rows(at)

    return count


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def _count_terms(block: pa.Table) -> pa.Table:
    """One block's terms per group: in how many documents, and how often."""
    is_chunk = pc.is_valid(block.column("k"))
    own, sent = block.filter(pc.invert(is_chunk)), block.filter(is_chunk)
    groups, sizes, lengths, steps = _unpacked(own.column("places")[0].as_py())
    group, n = np.repeat(np.arange(len(groups)), sizes), max(int(sizes.sum()), 1)
    # The chunks that nothing came back for are terms; the others are what came back, which may be nothing.
    names = pa.array(_whole(own.column("names")[0].as_py()).decode().split("\n"))
    is_term = np.ones(len(lengths), bool)
    is_term[sent.column("k").to_numpy()] = False
    sent = sent.filter(pc.is_valid(sent.column("term")))
    alone = np.flatnonzero(is_term)
    chunk = np.concatenate([alone, sent.column("k").to_numpy()]).astype(np.int64)
    terms = pa.concat_arrays([names.take(pa.array(alone)), sent.column("term").combine_chunks()]).dictionary_encode()
    # The entries of each row's chunk, one after the other.
    begin, size = (np.cumsum(lengths) - lengths)[chunk], lengths[chunk]
    at = np.repeat(begin - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    entries = np.cumsum(steps, out=steps)[at]
    del at, steps
    # By term, then by document, hence by group; a document may have a term by several chunks.
    key = np.repeat(terms.indices.to_numpy().astype(np.int64) * (n * (MOST + 1)), size)
    key += entries
    del entries
    key.sort()
    times = key % (MOST + 1)
    key //= MOST + 1
    once = _starts(key)
    code, of = key[once] // n, group[key[once] % n]
    cell = _starts(code * (len(groups) + 1) + of)
    n_docs = np.diff(np.append(cell, len(once)))
    total = np.add.reduceat(times, once[cell]) if len(cell) else np.empty(0, np.int64)
    found = {"of": groups[of[cell]].astype(np.int32), "term": terms.dictionary.take(pa.array(code[cell])), "n_docs": n_docs, "n": total}
    return pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in found.items()})


def _numbered_counts(texts: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """``lang`` and ``of`` (numbers of the language and the group), ``term``, ``n_docs``, ``n``; dealt by term."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    counted = texts.mapInArrow(_count_chunks({g: i for i, g in enumerate(groups)}), _COUNTED)
    counted.write.option("compression", "zstd").parquet(folder)
    counted = spark.read.schema(_COUNTED).parquet(folder)
    # Both sides of the join read this one shuffle: the dictionary has the chunks with what their rows hold.
    dealt = counted.filter("chunk IS NOT NULL").select("block", "chunk", "k").repartition("chunk")
    cut = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    chunks = dealt.groupBy("chunk").agg(F.min("block").alias("first"), F.max("k").alias("last"))
    dictionary = chunks.select(F.col("chunk").alias("word"), cut.alias("terms"), "first", "last").filter("first >= 0 AND last >= 0")
    # A chunk is one row of the dictionary, so a hash table of a partition of it does not depend on hot chunks.
    # What is asked of the dictionary's side alone would go below the shuffle of that side, which then is not the other's.
    changed = (F.col("k") < 0) | (F.col("terms") != F.array("chunk"))
    joined = dealt.join(dictionary.hint("shuffle_hash"), (F.col("chunk") == F.col("word")) & changed)
    by_term = joined.select("block", "k", F.explode_outer("terms").alias("term"))
    none = F.lit(None).cast("binary")
    places = counted.filter("places IS NOT NULL").select("block", "k", F.lit(None).cast("string").alias("term"), "places", "names")
    in_block = by_term.withColumns({"places": none, "names": none}).unionByName(places).groupBy("block").applyInArrow(_count_terms, _TERMS)
    # Dealt by term, which serves sums over a language as well.
    summed = in_block.repartition("term").groupBy("of", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    return summed.withColumn("lang", F.get(F.array(*[F.lit(i) for i in _languages(groups)]), "of"))


def _languages(groups: list[tuple[str, str]]) -> list[int]:
    """The number of each group's language."""
    names = {name: i for i, name in enumerate(sorted({lang for lang, _ in groups}))}
    return [names[lang] for lang, _ in groups]


def _groups(texts: DataFrame) -> list[tuple[str, str]]:
    return sorted((r.lang, r.source) for r in texts.select("lang", "source").distinct().collect())


def _named(spark: SparkSession, groups: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "of int, lang string, source string")


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n_docs`` (documents of the group that have the term) and ``n`` (occurrences).

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  A row is a document, also if
    it repeats another; NULL texts, languages and sources are empty ones.

    A block's documents are numbered, so distinct documents are counted inside a block and summed up: a chunk or
    term that every document has meets in one task as one row per block, not as one row per document.  The counted
    chunks are written to the shared folder once, so all that reads them agrees on the blocks, also when an executor
    is lost.  The list of groups comes to the driver.
    """
    texts = _texts(docs, lang, source, text)
    groups = _groups(texts)
    named = F.broadcast(_named(docs.sparkSession, groups))  # the list that the driver holds
    return _numbered_counts(texts, groups).drop("lang").join(named, "of").select("lang", "source", "term", "n_docs", "n")


def _exact_share(n: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SCALE * (n + 1) / whole)``; in Python's numbers where eight bytes are too few."""
    if len(n) and int(n.max()) >= 9_000_000_000:
        n = n.astype(object)
    return (1 + SCALE * (n + 1) // whole).astype(np.int64)


def _gaps(langs: np.ndarray, totals: np.ndarray, terms_of: np.ndarray, lang_totals: np.ndarray, top_terms: int):
    """For one shard of a language's terms: the summed gaps of every ordered pair of its groups, and each group's top terms.

    The arrays have, for each group, its language, its occurrences of kept terms, and its language's terms and
    occurrences.
    """

    def gaps(key: tuple, table: pa.Table) -> pa.Table:
        groups = np.flatnonzero(langs == key[0].as_py())
        size = int(terms_of[groups[0]])
        of, n = table.column("of").to_numpy(), table.column("n").to_numpy()
        column = table.column("term").combine_chunks()
        terms = column.dictionary_encode()
        p, q = _exact_share(n, totals[of] + size), _exact_share(table.column("lang_n").to_numpy(), int(lang_totals[groups[0]]) + size)
        absent = _exact_share(np.zeros(len(groups), np.int64), totals[groups] + size)
        shares = np.repeat(absent[:, None], len(terms.dictionary), axis=1)
        shares[np.searchsorted(groups, of), terms.indices.to_numpy()] = p
        values = np.concatenate([((share - shares) ** 2 // shares).sum(1) for share in shares])
        pairs = {"of": np.repeat(groups, len(groups)), "other": np.tile(groups, len(groups)), "value": values}
        found = pa.table({**{k: pa.array(v.astype(np.int64)) for k, v in pairs.items()}, "item": pa.nulls(len(values), pa.string())})
        # A group's top terms are among the top terms of its shards.
        above = np.flatnonzero(p > q)
        listed = pa.table({"of": of[above].astype(np.int64), "value": (p[above] - q[above]) ** 2 // q[above], "item": column.take(pa.array(above))})
        listed = listed.sort_by([("of", "ascending"), ("value", "descending"), ("item", "ascending")])
        begin = _starts(listed.column("of").to_numpy())
        rank = np.arange(len(listed)) - np.repeat(begin, np.diff(np.append(begin, len(listed))))
        listed = listed.filter(pa.array(rank < top_terms)).add_column(1, "other", pa.array(np.full(int((rank < top_terms).sum()), -1)))
        return pa.concat_tables([found, listed.select(found.column_names)])

    return gaps


def audit_divergence(
    docs: DataFrame, min_docs: int = 3, top_terms: int = 200, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far a source is from the others of its language.

    Each language keeps the ``V`` terms that ``min_docs`` of its documents have.  A source (and a whole language) with
    ``N`` occurrences of kept terms gives a term with ``n`` of them the share ``1 + floor(10^9 (n + 1) / (N + V))``, and
    ``(p - q)^2 / q``, rounded down, is the gap of two shares.  Part ``pair`` has one row for every other source of the
    language with the gaps to it summed over all kept terms (0 if there are none); part ``term`` has the
    ``top_terms`` terms of the source that lie farthest above their language's share, where the source has them at
    all.  Ranks go by value, then by the item's bytes.

    NULL texts, languages and sources are empty ones; repeated rows count; other columns are ignored; an empty table
    gives an empty result.  The list of sources and languages comes to the driver: the result has one row for every
    two of them.  Terms are dealt to shards by hash, so that a task compares at most about ``CELLS`` shares.
    """
    spark = docs.sparkSession
    texts = _texts(docs, lang, source, text)
    groups = _groups(texts)
    counts = _numbered_counts(texts, groups)
    folder = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    same = Window.partitionBy("term", "lang")
    counts = counts.withColumns({"docs_of_lang": F.sum("n_docs").over(same), "lang_n": F.sum("n").over(same)})
    counts.filter(F.col("docs_of_lang") >= min_docs).select("lang", "term", "of", "n", "lang_n").write.parquet(folder)
    kept = spark.read.schema("lang int, term string, of int, n long, lang_n long").parquet(folder)

    langs = np.array(_languages(groups), np.int64)
    total = {r.of: r.n for r in kept.groupBy("of").agg(F.sum("n").alias("n")).collect()}
    once = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang")
    vocabulary = {r.lang: (r.terms, r.n) for r in once.agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n")).collect()}
    totals = np.array([total.get(i, 0) for i in range(len(groups))], np.int64)
    terms_of, lang_totals = (np.array([vocabulary.get(int(i), (0, 0))[k] for i in langs], np.int64) for k in (0, 1))
    shards = [max(1, math.ceil(int(terms_of[langs == i][0]) * int((langs == i).sum()) / CELLS)) for i in range(len(set(langs)))]
    shard = F.pmod(F.xxhash64("term"), F.get(F.array(*[F.lit(k) for k in shards]), "lang")).alias("shard")
    sharded = kept.select("lang", shard, "of", "term", "n", "lang_n").groupBy("lang", "shard")
    gaps = sharded.applyInArrow(_gaps(langs, totals, terms_of, lang_totals, top_terms), "of long, other long, value long, item string")
    gaps = gaps.groupBy("of", "other", "item").agg(F.sum("value").alias("value"))

    # One row a group: the list that the driver holds already.
    one = F.broadcast(_named(spark, groups))
    other = F.broadcast(_named(spark, groups).select(F.col("of").alias("other"), F.col("lang").alias("other_lang"), F.col("source").alias("name")))
    found = gaps.join(one, "of").join(other, "other", "left")
    part, item = F.when(F.col("other") >= 0, F.lit("pair")).otherwise(F.lit("term")).alias("part"), F.coalesce("item", "name").alias("item")
    rows = found.filter("of <> other").select("lang", "source", part, item, "value")
    # Languages without terms have no shards, but pairs.
    bare = {lang for (lang, _), terms in zip(groups, terms_of, strict=True) if not terms}
    pairs = one.join(other, (F.col("lang") == F.col("other_lang")) & (F.col("of") != F.col("other"))).filter(F.col("lang").isin(*bare))
    rows = rows.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("name").alias("item"), F.lit(0).cast("long").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top_terms))


def audit_divergence_sql(documents: str = "documents", min_docs: int = 3, top_terms: int = 200) -> str:
    """DuckDB: the same rows, from every term of every document and every pair of sources."""
    return rf"""
    WITH texts AS MATERIALIZED (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM {documents}),
    groups AS (SELECT DISTINCT lang, source FROM texts),
    words AS (SELECT r, lang, source, unnest(terms) AS term FROM texts),
    kept AS MATERIALIZED (
        SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
    counted AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
        FROM groups g JOIN kept k ON k.lang = g.lang
        LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c
            ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sized AS (
        SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
            sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total FROM counted),
    shared AS MATERIALIZED (
        SELECT lang, source, term, n, (1 + {SCALE} * (n + 1) // (total + v))::HUGEINT AS p,
            (1 + {SCALE} * (lang_n + 1) // (lang_total + v))::HUGEINT AS q FROM sized),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
        SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
        LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shared WHERE n > 0 AND p > q)
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    WHERE part = 'pair' OR rank <= {top_terms}"""
