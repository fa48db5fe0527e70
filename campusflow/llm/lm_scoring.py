"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted by Spark and mapped by workers.

Bigrams are counted per task, packed, and dealt to shards by their first word; a shard's types are written to
the shared folder as sorted arrays of hashes and counts.  Word statistics go the same way.  Workers map the
files into memory and look up whole batches of hashes by binary search.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.rows import unpacked
from campusflow.llm.stored import shared_folder, stored
from campusflow.llm.tokens import IS_SPACE, Words, mix, row_slices

BEGIN, END = (mix(np.array([x], np.uint64))[0] for x in (0xB0, 0xE0))  # not the hash of any word in practice
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
CHUNK_TOKENS = 1 << 21
LOOKUP_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 21
# A word with more than this share of the tokens is hot: its bigrams are dealt by both words.  There are
# 1 / HOT_SHARE such words at most.
HOT_SHARE = 0.0005
# Bigram counts are stored in four bytes; the few that are larger stand with their places in an array of their own.
FOUR_BYTES = 0xFFFFFFFF
_DEALT = "shard int, first binary, second binary, n binary"
_COUNTED = "shard int, kind string, word binary, sums binary"
_STATS = "name string, value double"


def bigram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first * _FACTOR) + second)


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' tokens, ends included: the token before (BEGIN at first), the token, and the first of each text."""
    words = Words(texts, IS_SPACE, lower=True)
    counts = words.counts
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    token = np.empty(first[-1], np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[first[1:] - 1] = True
    token[~is_end] = words.hashes()
    token[is_end] = END
    before = np.concatenate((token[-1:], token[:-1]))
    before[first[:-1]] = BEGIN
    return before, token, first


def _summed(keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order (the first key leads) with the sums of their values' rows."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return tuple(k[starts] for k in keys), np.add.reduceat(values[order], starts, axis=0) if len(starts) else values[:0]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words that are frequent in a slice, and of all tokens (NULL)."""
    total: dict[int, int] = {}
    n = 0
    for _, texts in row_slices(batches, "body"):
        _, token, _ = _sequences(texts)
        word, count = np.unique(token, return_counts=True)
        often = count >= HOT_SHARE / 2 * len(token)
        n += len(token)
        for w, c in zip(word[often].view(np.int64).tolist(), count[often].tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    # What was frequent in few slices only is not frequent in the task.
    rows = [(w, c) for w, c in total.items() if c >= HOT_SHARE / 4 * n] + [(None, n)]
    yield pa.RecordBatch.from_pydict(
        {"word": pa.array([w for w, _ in rows], pa.int64()), "n": pa.array([c for _, c in rows], pa.int64())}
    )


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal values in a sorted array."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[a]), slice(int(a), int(b))


def _deal(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _bigram_chunks(hot: np.ndarray, shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def chunk() -> pa.RecordBatch:
            before, token = (np.concatenate(x) for x in zip(*held, strict=True))
            (first, second), n = _summed((before, token), np.ones(len(before), np.int64))
            home = np.where(np.isin(first, hot), bigram_hash(first, second), first)
            shard = _deal(mix(home), shards)
            order = np.argsort(shard, kind="stable")
            first, second, n, shard = first[order], second[order], n[order].astype(np.uint32), shard[order]
            parts = list(_by_shard(shard))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([s for s, _ in parts], pa.int32())}
                | {
                    name: pa.array([values[at].tobytes() for _, at in parts], pa.binary())
                    for name, values in (("first", first), ("second", second), ("n", n))
                }
            )

        size = 0
        for _, texts in row_slices(batches, "body"):
            before, token, _ = _sequences(texts)
            held.append((before, token))
            size += len(token)
            if size >= CHUNK_TOKENS:
                yield chunk()
                held.clear()
                size = 0
        if size:
            yield chunk()

    return count


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a name that it gets when it is whole, so a task may run twice."""
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    files.move(part, f"{path}/{name}")


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one shard after the other."""
    held: list[dict] = []
    for row in (r for batch in batches for r in batch.to_pylist()):
        if held and row["shard"] != held[0]["shard"]:
            yield held[0]["shard"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["shard"], held


def _joined(rows: list[dict], name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def _bigram_shards(folder: str, word_shards: int):
    """Write each shard's bigrams, and send on sums per first word and the number of types per second word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shard_rows(batches):
            keys = (_joined(rows, "first", np.uint64), _joined(rows, "second", np.uint64))
            (first, second), n = _summed(keys, _joined(rows, "n", np.uint32).astype(np.int64))
            code = bigram_hash(first, second)
            order = np.argsort(code)
            _write(folder, f"bigram-{shard}-hash", code[order])
            _write(folder, f"bigram-{shard}-n", np.minimum(n[order], FOUR_BYTES).astype(np.uint32))
            large = np.flatnonzero(n[order] > FOUR_BYTES)
            if len(large):
                _write(folder, f"bigram-{shard}-large", np.column_stack((large, n[order][large])))
            of_first = np.column_stack((n, n == 1, n == 2, n >= 3, n == 3, n == 4)).astype(np.int64)
            (by_first,), sums = _summed((first,), of_first)
            (by_second,), types = _summed((second,), np.ones((len(second), 1), np.int64))
            out: dict[str, list] = {"shard": [], "kind": [], "word": [], "sums": []}
            for kind, word, values in (("first", by_first, sums), ("second", by_second, types)):
                dealt = _deal(mix(word), word_shards)
                order = np.argsort(dealt, kind="stable")
                for to, at in _by_shard(dealt[order]):
                    out["shard"].append(to)
                    out["kind"].append(kind)
                    out["word"].append(word[order][at].tobytes())
                    out["sums"].append(values[order][at].tobytes())
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array(out["shard"], pa.int32()), "kind": pa.array(out["kind"], pa.string())}
                | {c: pa.array(out[c], pa.binary()) for c in ("word", "sums")}
            )

    return count


#: Of a word: its tokens before others, its following types seen once, twice, more often, and its preceding types.
WORD_SUMS = ("n", "once", "twice", "more", "types")


def _word_shards(folder: str):
    """Write each shard's words, and give out the corpus-wide sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shard_rows(batches):
            by_kind = {k: [r for r in rows if r["kind"] == k] for k in ("first", "second")}
            first, second = (_joined(by_kind[k], "word", np.uint64) for k in ("first", "second"))
            values = np.zeros((len(first) + len(second), 7), np.int64)
            values[: len(first), :6] = _joined(by_kind["first"], "sums", np.int64).reshape(-1, 6)
            values[len(first) :, 6] = _joined(by_kind["second"], "sums", np.int64)
            (word,), sums = _summed((np.concatenate((first, second)),), values)
            n, once, twice, more, three, four, types = sums.T
            _write(folder, f"word-{shard}-hash", word)
            _write(folder, f"word-{shard}-sums", np.column_stack((n, once, twice, more, types)))
            stats = {"tokens": n.sum(), "words": (word != BEGIN).sum(), "texts": n[word == BEGIN].sum()}
            stats |= {"bigrams_1": once.sum(), "bigrams_2": twice.sum(), "bigrams_3": three.sum()}
            stats |= {"bigrams_4": four.sum(), "bigrams": (once + twice + more).sum()}
            stats |= {f"types_{k}": (types == k).sum() for k in (1, 2, 3, 4)} | {"types_more": (types >= 3).sum()}
            yield pa.RecordBatch.from_pydict(
                {"name": pa.array(list(stats)), "value": pa.array([float(v) for v in stats.values()], pa.float64())}
            )

    return count


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes off counts of 1, 2 and 3 or more, from the counts of counts.

    Where a count of counts is 0 the formula says nothing; the absolute discount, or a half, stands in.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = (
        1 - 2 * y * n2 / n1 if n1 and n2 else y,
        2 - 3 * y * n3 / n2 if n2 and n3 else y,
        3 - 4 * y * n4 / n3 if n3 and n4 else y,
    )
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, into how many shards they go, and the corpus-wide sums."""

    folder: str
    bigram_shards: int
    word_shards: int
    sums: dict[str, float]


_mapped: dict[str, np.ndarray] = {}


def _map(folder: str, name: str, kind: type) -> np.ndarray:
    """An array of the model, mapped into memory: where it lies if that is a file system, else from a local copy."""
    key = f"{folder}/{name}"
    if key not in _mapped:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        info = files.get_file_info(f"{path}/{name}")
        if info.type == pyarrow.fs.FileType.NotFound or not info.size:
            _mapped[key] = np.empty(0, kind)  # no text had a key of this shard
        elif urlparse(folder).scheme in ("", "file"):
            _mapped[key] = np.memmap(info.path, kind, "r")
        else:
            local = os.path.join(tempfile.mkdtemp(prefix="model-"), name)
            pyarrow.fs.copy_files(f"{path}/{name}", local, source_filesystem=files)
            _mapped[key] = np.memmap(local, kind, "r")
    return _mapped[key]


def _find(folder: str, kind: str, shards: int, hashes: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard: the places in ``hashes`` that it has, and where it has them."""
    order = np.lexsort((hashes, shard))
    for s, at in _by_shard(shard[order]):
        asked = order[at]
        known = _map(folder, f"{kind}-{s}-hash", np.uint64)
        if len(known):
            place = np.searchsorted(known, hashes[asked])
            place[place == len(known)] = 0
            hit = known[place] == hashes[asked]
            yield s, asked[hit], place[hit]


class _Scorer:
    def __init__(self, model: Model, hot: np.ndarray) -> None:
        self.model, self.hot = model, hot
        s = model.sums
        self.upper = np.array([0, *discounts(*(s.get(f"bigrams_{k}", 0.0) for k in (1, 2, 3, 4)))])
        self.lower = np.array([0, *discounts(*(s.get(f"types_{k}", 0.0) for k in (1, 2, 3, 4)))])
        self.all_types = s.get("bigrams", 0.0)
        self.words = s.get("words", 0.0)
        more = s.get("types_more", 0.0)
        self.spare = self.lower[1:] @ np.array([s.get("types_1", 0.0), s.get("types_2", 0.0), more])

    def _word_sums(self, words: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(words), len(WORD_SUMS)), np.int64)
        shards = self.model.word_shards
        for s, asked, place in _find(self.model.folder, "word", shards, words, _deal(mix(words), shards)):
            sums[asked] = _map(self.model.folder, f"word-{s}-sums", np.int64).reshape(-1, len(WORD_SUMS))[place]
        return sums

    def _bigram_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        code = bigram_hash(first, second)
        shards = self.model.bigram_shards
        shard = _deal(mix(np.where(np.isin(first, self.hot), code, first)), shards)
        n = np.zeros(len(code), np.int64)
        for s, asked, place in _find(self.model.folder, "bigram", shards, code, shard):
            found = _map(self.model.folder, f"bigram-{s}-n", np.uint32)[place].astype(np.int64)
            large = _map(self.model.folder, f"bigram-{s}-large", np.int64).reshape(-1, 2)
            if len(large):
                at = np.minimum(np.searchsorted(large[:, 0], place), len(large) - 1)
                found = np.where(large[at, 0] == place, large[at, 1], found)
            n[asked] = found
        return n

    def score(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: log10 of its probability, of its add-one probability, and whether training had it."""
        words, of = np.unique(np.concatenate((before, token)), return_inverse=True)
        sums = self._word_sums(words)
        n, once, twice, more, types = sums.T.astype(np.float64)
        s = self.model.sums
        count = np.where(words == END, s.get("texts", 0.0), n)
        base = np.log10((count + 1) / (s.get("tokens", 0.0) + 1 * (self.words + 1)))
        uniform = 1 / (self.words + 1)
        if self.all_types:
            taken = np.maximum(types - self.lower[np.minimum(types, 3).astype(int)], 0)
            unigram = taken / self.all_types + self.spare / self.all_types * uniform
        else:
            unigram = np.full(len(words), uniform)
        free = self.upper[1] * once + self.upper[2] * twice + self.upper[3] * more
        h, w = of[: len(before)], of[len(before) :]
        pair = self._bigram_counts(before, token)
        seen = np.maximum(n[h], 1)
        bigram = np.maximum(pair - self.upper[np.minimum(pair, 3)], 0) / seen + free[h] / seen * unigram[w]
        return np.log10(np.where(n[h] > 0, bigram, unigram[w])), base[w], count[w] > 0


def _scored(model: Model, hot: np.ndarray, text: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model, hot)
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = []

        def results() -> Iterator[pa.RecordBatch]:
            lp, base, known = scorer.score(*(np.concatenate([h[k] for h in held]) for k in (1, 2)))
            at = 0
            for batch, _, token, first in held:
                columns = [*batch.columns, pa.array(np.diff(first))]
                for values in (known.astype(np.int64), base, lp):
                    # Every text has a token, its end.
                    columns.append(pa.array(np.add.reduceat(values[at : at + len(token)], first[:-1])))
                names = ["row", "held_out", "n_tokens", "n_known", "base_score", "score"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(token)

        size = 0
        for batch, texts in row_slices(batches, text):
            before, token, first = _sequences(texts)
            held.append((batch, before, token, first))
            size += len(token)
            if size >= LOOKUP_TOKENS:
                yield from results()
                held.clear()
                size = 0
        if size:
            yield from results()

    return score


def in_training(doc_id: Column, parts: int = 7, held_out: int = 2) -> Column:
    """Whether a document is learned from: its id's CRC-32 modulo ``parts`` is not ``held_out``.  Without id it is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held_out, F.lit(True))


def train(texts: DataFrame) -> tuple[Model, np.ndarray]:
    """The model of the texts (column ``row`` with field ``body``), and the hot words, which its shards depend on."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    if not urlparse(folder).scheme:
        folder = f"file://{os.path.abspath(folder)}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path)

    often = stored(texts.mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens = often.filter("word IS NULL").select("n").first()
    tokens = (tokens[0] or 0) if tokens else 0
    hot_rows = often.filter((F.col("word").isNotNull()) & (F.col("n") >= HOT_SHARE * tokens)).collect()
    hot = np.array(sorted(r.word for r in hot_rows), np.int64).view(np.uint64)
    shards = max(1, math.ceil(tokens / SHARD_TOKENS))
    word_shards = max(1, math.ceil(shards / 4))

    dealt = texts.mapInArrow(_bigram_chunks(hot, shards), _DEALT)
    in_order = dealt.repartition("shard").sortWithinPartitions("shard")
    counted = in_order.mapInArrow(_bigram_shards(folder, word_shards), _COUNTED)
    by_word = counted.repartition("shard").sortWithinPartitions("shard")
    sums = by_word.mapInArrow(_word_shards(folder), _STATS).groupBy("name").agg(F.sum("value").alias("value"))
    return Model(folder, shards, word_shards, {r.name: r.value for r in sums.collect()}), hot


def score_corpus(
    docs: DataFrame, training: Column | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    Tokens are the words (runs without ASCII white space, A-Z lower-cased) and one end; the model learns from the
    documents for which ``training`` holds (``in_training`` of the id by default) and scores all.  ``score`` is log10 of
    the probability of the text under the interpolated modified Kneser-Ney bigram model, with one share for an
    unknown word; ``base_score`` is that of add-one unigrams.  ``n_known`` counts tokens that training had.

    A NULL text is empty: its only token is the end.  Without any training text every token has the uniform
    probability 1 / (0 + 1).  Repeated rows count and are scored each.  A caller's column with the name of an added
    one is replaced.  Words and bigrams are told apart by 64-bit hashes.

    The model's files stay in the shared folder.  Their size follows the number of distinct bigrams; workers read
    only the pages they need.  A task holds a chunk of tokens or one shard.
    """
    kept = in_training(docs[doc_id]) if training is None else training
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    model, hot = train(docs.filter(kept).select(F.struct(body.alias("body")).alias("row")))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    every = docs.select(row, (~kept).alias("held_out"))
    kinds = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    schema = every.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()}).schema
    scored = every.mapInArrow(_scored(model, hot, text), schema)
    added = {n: F.col(n) for n in ("held_out", "n_tokens", "n_known")}
    added["train_tokens"] = F.lit(int(model.sums.get("tokens", 0))).cast("long")
    added |= {n: F.col(n) for n in ("base_score", "score")}
    added["perplexity"] = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return unpacked(scored, docs.columns, added)
