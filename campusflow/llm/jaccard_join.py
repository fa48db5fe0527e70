"""N-gram Jaccard join through a matrix of tokens and groups.

Documents become sets of hashed word n-grams; equal sets are one class.  Each set gets keys such that two sets
similar enough share some (see ``_Keys``); a set that shares fewer with others links with none.  Sets that
share a key are compared with a few leaders first, which joins near copies into groups.  For the rest, each
group stores the union of its members' tokens; a set is compared with a group's members only if its overlap
with that union can still reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.components import connected_components
from campusflow.llm.rows import packed, same_row, unpacked
from campusflow.llm.stored import release, stored
from campusflow.llm.tokens import IS_SPACE, Words, inside_text, mix, row_slices, sequence_hashes

# Keys are dealt to shards of about so many; a task holds one shard, and sends keys on in chunks.
SHARD_KEYS = 1 << 20
CHUNK_KEYS = 1 << 20
# Keys for parts that two similar sets share at least; a set of which fewer are shared with others links with none.
SHARED = 3
SUPPORT_ROUNDS = 2
LEADERS = 3
# Tokens of the sets of one group together, which bounds its row whatever the sets' sizes.
GROUP_TOKENS = 1 << 16


class _Keys:
    """Keys of a set, so that any two sets with Jaccard similarity of ``percent`` / 100 or more share one.

    Such sets differ in at most (100 - p) / (100 + p) of their sizes' sum, and their sizes by p / 100.  Sizes
    fall into classes so wide that similar sets lie in the same or neighbouring ones; a set gets keys for its
    class with the next, and for the class before with its own.  If a class pair allows D differences, tokens
    are dealt to D + E + SHARED parts by hash, and a part's content is the key.  E is about the number of parts
    that the smallest of these sets leaves empty.  At least E + SHARED parts are the same in both sets; a set
    passes over its empty parts if they are E at most, so both have at least SHARED keys in common.  These keys
    are even numbers.  For D of 1 the keys are the set and the set without each one of its tokens, as odd numbers:
    sharing one of them is enough.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.starts = [1]

    @lru_cache(maxsize=None)  # noqa: B019 - as long-lived as its few classes
    def _differences(self, c: int) -> int:
        top = self._start(c + 1) - 1
        return (100 - self.percent) * (top + top * 100 // self.percent) // (100 + self.percent)

    def _start(self, c: int) -> int:
        while len(self.starts) <= c:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return self.starts[c]

    @lru_cache(maxsize=None)  # noqa: B019
    def _empty(self, c: int) -> int:
        parts = self._differences(c) + SHARED
        expected = parts * math.exp(-self._start(c) / parts)
        return math.ceil(expected + 2 * math.sqrt(expected))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The distinct keys of a set of at least one token."""
        n = len(tokens)
        while self._start(len(self.starts) - 1) <= n:
            self._start(len(self.starts))
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        return np.concatenate([self._for_pair(c, tokens) for c in (own, own - 1) if c >= 0])

    def _for_pair(self, c: int, tokens: np.ndarray) -> np.ndarray:
        differences, salt = self._differences(c), mix(np.array([c + 1], np.uint64))
        mixed = mix(tokens ^ salt)
        if differences <= 1:
            whole = mixed.sum(dtype=np.uint64)
            return mix(np.concatenate(([whole], whole - mixed if differences else mixed[:0])) + salt) | np.uint64(1)
        empty = self._empty(c)
        parts = differences + empty + SHARED
        part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        contents = np.zeros(parts, np.uint64)
        np.add.at(contents, part.astype(np.int64), mix(mixed))
        chosen = np.bincount(part.astype(np.int64), minlength=parts) > 0
        if parts - chosen.sum() > empty:
            chosen[:] = True
        return mix(mix(contents + salt) + np.arange(parts, dtype=np.uint64))[chosen] & ~np.uint64(1)


def _sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct hashed n-grams, sorted; a shorter text is one n-gram, one without words none."""
    hashes = words.hashes()
    grams = sequence_hashes(hashes, n)[inside_text(words.first, n)]
    counts = words.counts
    ends = np.cumsum(np.maximum(counts - n + 1, 0))
    for text, (count, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if count >= n:
            yield np.unique(grams[end - (count - n + 1) : end])
        else:
            first = int(words.first[text])
            yield sequence_hashes(hashes[first : first + count], count) if count else hashes[:0]


def _node(tokens: np.ndarray) -> np.uint64:
    """A name for the set of tokens."""
    return mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0]


def _pairs_batch(keys: np.ndarray, nodes: np.ndarray) -> dict[str, pa.Array]:
    return {"key": pa.array(keys.view(np.int64)), "node": pa.array(nodes.view(np.int64))}


def _shared(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) by key and node, and whether another node has the same key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    same = keys[1:] == keys[:-1]
    return keys, nodes, np.concatenate((same, [False])) | np.concatenate(([False], same))


_DEALT = "shard int, keys binary, nodes binary, key long, node long"
_POSTINGS = "key long, node long"


def _dealt(batches: Iterator[pa.RecordBatch], n: int, percent: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Keys packed for their shards.

    Sets that meet in a chunk already are given out as postings at once, and only the first of them is sent on
    for their key: so a key that very many sets share is sent once from each chunk.
    """
    schema = pa.schema(
        [("shard", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("key", pa.int64()), ("node", pa.int64())]
    )
    maker, keys, nodes, seen, held = _Keys(percent), [], [], set(), 0

    def chunk() -> Iterator[pa.RecordBatch]:
        key, node, shared = _shared(np.concatenate(keys), np.concatenate(nodes))
        if shared.any():
            posted = _pairs_batch(key[shared], node[shared])
            empty = {f: pa.nulls(len(posted["key"]), schema.field(f).type) for f in ("shard", "keys", "nodes")}
            yield pa.RecordBatch.from_pydict(empty | posted, schema)
            first = np.concatenate(([True], key[1:] != key[:-1]))
            key, node = key[first], node[first]
        shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        order = np.lexsort((node, shard))  # the keys of one set side by side, which packs better
        key, node, shard = key[order], node[order], shard[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        spans = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([int(shard[a]) for a, _ in spans], pa.int32()),
                "keys": pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()),
                "nodes": pa.array([node[a:b].tobytes() for a, b in spans], pa.binary()),
                "key": pa.nulls(len(spans), pa.int64()),
                "node": pa.nulls(len(spans), pa.int64()),
            },
            schema,
        )

    for _, texts in row_slices(batches, "body"):
        for tokens in _sets(Words(texts, IS_SPACE, lower=True), n):
            if not len(tokens) or (node := int(_node(tokens))) in seen:
                continue
            seen.add(node)
            keys.append(maker.of(tokens))
            nodes.append(np.full(len(keys[-1]), node, np.uint64))
            held += len(keys[-1])
            if held >= CHUNK_KEYS:
                yield from chunk()
                keys, nodes, held = [], [], 0
                if len(seen) > CHUNK_KEYS:
                    seen.clear()  # only spares repeated work
    if held:
        yield from chunk()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of keys that sets from different chunks share; shards come one after the other."""
    shard, keys, nodes = None, [], []

    def postings() -> Iterator[pa.RecordBatch]:
        if keys:
            key, node, shared = _shared(np.concatenate(keys), np.concatenate(nodes))
            if shared.any():
                yield pa.RecordBatch.from_pydict(_pairs_batch(key[shared], node[shared]))

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                yield from postings()
                shard, keys, nodes = row["shard"], [], []
            keys.append(np.frombuffer(row["keys"], np.uint64))
            nodes.append(np.frombuffer(row["nodes"], np.uint64))
    yield from postings()


def _supported(postings: DataFrame) -> DataFrame:
    """The postings of sets that share as many keys with others as a link needs, as far as another such set shares them."""
    for _ in range(SUPPORT_ROUNDS):
        odd = F.col("key").bitwiseAND(F.lit(1))
        counted = postings.groupBy("node").agg(F.count(F.lit(1)).alias("keys"), F.max(odd).alias("alone"))
        kept = postings.join(counted.filter((F.col("alone") == 1) | (F.col("keys") >= SHARED)).select("node"), "node")
        shared = kept.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("key")
        postings = stored(kept.join(shared, "key").select("key", "node"))
    return postings


def _linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _links(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that connect all sets which similar sets among the postings connect.

    The leader of a key is the set whose keys are shared most: the middle of a family of near copies is the leader of
    most of its keys, and more of the family are similar to it than to any other.
    """
    sharing = postings.groupBy("key").agg(F.count(F.lit(1)).alias("sharing"))
    weights = postings.join(sharing, "key").groupBy("node").agg(F.sum("sharing").alias("weight"))
    leads = postings.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    met = postings.join(leads, "key").filter("node <> leader").groupBy("node")
    few = met.agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("leader").alias("h"), "leader"))), 1, LEADERS).alias("l"))
    pairs = few.select(F.col("node").alias("a"), F.explode("l.leader").alias("b"))
    links = stored(_compared(pairs, sets, percent))
    release(sets.sparkSession)
    return links.unionByName(_opened(postings.join(_labels(postings, links), "node"), sets, percent))


def _labels(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Each set's component so far."""
    known = connected_components(links)
    every = postings.select("node").distinct().join(known, "node", "left")
    return stored(every.select("node", F.coalesce("component", "node").alias("component")))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").filter(_linked(F.col("of_a"), F.col("of_b"), percent)).select("a", "b")


def _open_rows(placed: DataFrame) -> DataFrame:
    """The postings whose key is shared by sets of different components, with the number of sets that share it."""
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("sharing")
    )
    return placed.join(mixed.filter("low <> high").select("key", "sharing"), "key")


def _linkable(tokens: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``n`` of sets with enough tokens that another of the sets has; no other can have a link here."""
    each = tokens.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("token")
    counted = each.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("both"), F.min("n").alias("n"))
    return counted.filter(100 * F.col("both") >= percent * F.col("n")).select("node", "n")


def _opened(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different components that share a key: the matrix of tokens and groups.

    A group holds sets of one large component, or else sets whose most shared key is the same, of up to about
    GROUP_TOKENS tokens, so sets that share many keys tend to be in one group.  A set meets its own group through that
    key alone, and each later group that it shares a key with, once however many keys they share.  Groups of one
    component come last: what is left of a family meets the part of it that is joined already, not the other
    way round.  Sizes, then the overlap with the group's union, decide which groups are opened, and within an
    opened one a set is compared with the sets of other components.
    """
    rows = stored(_open_rows(placed))
    open_sets = rows.select("node").distinct()
    able = _linkable(sets.join(open_sets, "node", "left_semi"), percent)
    rows = stored(_open_rows(rows.drop("sharing").join(able, "node")))
    release(sets.sparkSession)

    leads = rows.groupBy("node", "component", "n").agg(F.max_by("key", F.struct("sharing", "key")).alias("lead"))
    tokens = leads.groupBy("component").agg((F.sum("n") >= GROUP_TOKENS).alias("alone"))
    lead = F.when(F.col("alone"), F.col("component")).otherwise(F.col("lead")).alias("lead")
    leads = stored(leads.join(tokens, "component").select("node", "component", "n", "alone", lead))
    sizes = leads.groupBy("alone", "lead").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    grouped = stored(
        leads.join(sizes, ["alone", "lead"]).select("node", "component", "n", F.struct("alone", "lead", block.alias("block")).alias("group"))
    )
    release(sets.sparkSession)
    groups = grouped.join(sets, "node").groupBy("group").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"),
        F.collect_list(F.struct("node", "component", "tokens")).alias("members"),
        F.min(F.size("tokens")).alias("least"),
        F.max(F.size("tokens")).alias("most"),
    )
    keyed = rows.select("key", "node").join(grouped, "node")
    here = keyed.groupBy("key", "group").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    seen = keyed.select("key", "n", F.col("node").alias("a"), F.col("component").alias("own"), F.col("group").alias("home"))
    sized = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    met = seen.join(here, "key").filter(
        sized & F.expr("(home < group OR (home = group AND key = group.lead)) AND NOT (low = own AND high = own)")
    )
    met = met.select("a", "own", "group").distinct()

    query = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    size = F.size("of_a")
    bounded = met.join(query, "a").join(groups, "group")
    bounded = bounded.filter((100 * F.col("most") >= percent * size) & (100 * size >= percent * F.col("least")))
    # A member of n tokens shares at most what the union shares, so the similarity is bound / (size + n - bound) at most.
    bound = F.size(F.array_intersect("of_a", "union"))
    rest = F.greatest(F.col("least") - bound, F.lit(0))
    opened = bounded.filter(100 * bound >= percent * (size + rest))
    linked = F.filter(
        "members", lambda m: (m["component"] != F.col("own")) & _linked(F.col("of_a"), m["tokens"], percent)
    )
    return opened.select("a", F.explode(F.transform(linked, lambda m: m["node"])).alias("b"))


def similarity_components(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc``, ``mark``, ``n_shingles``, ``node`` (its class), ``component``, ``component_id``.

    Words are runs without ASCII white space, with A-Z lower-cased.  A document's set has its distinct n-grams
    (64-bit hashes); a shorter document is one n-gram.  Documents link if 100 * intersection >= percent * union;
    ``component_id`` is the smallest id that links reach.  A document without words, or with a NULL text, has
    an empty set, NULL ``node``, and links with nothing; its ``component_id`` is its own id.  A NULL id takes part but
    names no component.  Repeated rows are one class and get a row each.

    Nothing is cut off: every set gets keys for every possible difference, all sets that share a key end up
    compared or in one component, and only classes, not copies, are compared.
    """
    bodies = packed(docs, doc_id, text).select("doc", "mark", F.struct("body").alias("row"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_slices(batches, "body"):
            sets = list(_sets(Words(texts, IS_SPACE, lower=True), n))
            nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array(nodes, mask=sizes == 0), pa.array(sizes)],
                ["doc", "mark", "node", "n_shingles"],
            )

    rows = stored(bodies.mapInArrow(classed, "doc long, mark long, node long, n_shingles long"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    # A set of n has about 2 * n * (100 - p) / (100 + p) * 2 keys.
    shards = max(1, math.ceil(4 * total * (100 - percent) / (100 + percent) / SHARD_KEYS))

    dealt = bodies.select("row").mapInArrow(lambda batches: _dealt(batches, n, percent, shards), _DEALT)
    met = dealt.filter("shard IS NOT NULL").repartition("shard").sortWithinPartitions("shard")
    across = met.select("shard", "keys", "nodes").mapInArrow(_gathered, _POSTINGS)
    within = dealt.filter("shard IS NULL").select("key", "node")
    postings = _supported(stored(across.unionByName(within).distinct()))
    release(docs.sparkSession)

    wanted = rows.join(postings.select("node").distinct(), "node", "left_semi")
    chosen = wanted.groupBy("node").agg(F.min(F.struct("doc", "mark")).alias("first")).select("node", "first.*")
    given = bodies.select("doc", "mark", F.col("row.body").alias("body"))
    texts = given.join(chosen, same_row(given, chosen)).select("node", F.struct("body").alias("row"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in row_slices(batches, "body"):
            sets = [s.view(np.int64) for s in _sets(Words(bodies, IS_SPACE, lower=True), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"]
            )

    sets = stored(texts.mapInArrow(tokenised, "node long, tokens array<long>").dropDuplicates(["node"]))
    release(docs.sparkSession)
    labels = connected_components(_links(postings, sets, percent))
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"))
    placed = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_node = placed.join(ids, "component").select("node", "component", "component_id")
    found = rows.join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return found.select("doc", "mark", "n_shingles", "node", "component", own.alias("component_id"))


def one_per_component(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents, with the columns they came with, but one row only of each component.

    The row with the smallest id stays (any id before none); among rows of that id the text that hashes lowest,
    and one of equal rows.  Documents without words, or with a NULL text, link with nothing, so all of them stay.
    """
    found = similarity_components(docs, n, percent, doc_id, text).filter("node IS NOT NULL")
    counted = found.groupBy("component", "doc", "mark").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark", "copies")).alias("best")
    chosen = stored(counted.groupBy("component").agg(best).select("best.doc", "best.mark", "best.copies"))
    rows = packed(docs, doc_id, text)
    without_words = rows.filter(F.btrim("body", F.lit(" \t\n\x0b\f\r")) == "").select("row")
    given = rows.select("row", "doc", "mark")

    def staying(which: DataFrame) -> DataFrame:
        return given.join(which, same_row(given, which)).select("row", given["doc"], given["mark"])

    # Only rows that the table repeats need to be told apart after the join.
    single = staying(chosen.filter("copies = 1")).select("row")
    repeated = staying(chosen.filter("copies > 1")).dropDuplicates(["doc", "mark"]).select("row")
    return unpacked(single.unionByName(repeated).unionByName(without_words), docs.columns, {})
