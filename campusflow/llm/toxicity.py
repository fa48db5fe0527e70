"""Toxicity by a weighted finite-state pattern grammar: what counts is a clause and how it says a word, not the word.

Small transducers follow a clause word by word: one knows whether a negation still reaches, one whether speech is
reported, one whether somebody is addressed.  Composed, they give every insult or threat in the clause the state it
stands in.  The words themselves and the weights of the states are learned from labelled documents; without labels the
lists and prior weights below hold.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.rows import unpacked, whole_rows
from campusflow.llm.stored import stored
from campusflow.llm.tokens import row_slices

# The closed word classes of the grammar, and the words it starts from, in four languages.
TARGETS = """you your yours yourself yourselves u ur he she they him her them his their
    du dich dir dein deine deiner euch euer ihr sie ihn
    tu toi te ton ta tes vous votre vos il elle ils elles
    tú tu ti te usted ustedes vosotros tus vuestro él ella ellos ellas""".split()
NEGATIONS = """not no never neither nor without isn aren wasn weren don doesn didn won wouldn couldn shouldn cannot
    nicht kein keine keinen keiner nie niemals ohne
    ne pas jamais aucun aucune sans
    no nunca jamás ni sin ningún ninguna""".split()
REPORTS = """said says saying told called calls quoted quote wrote writes claimed claims reported
    sagte sagt nannte nennt schrieb behauptete zitierte
    dit disait appelle appelait écrit affirme cite
    dijo dice llamó llama escribió afirmó citó""".split()
INSULTS = """idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting clown imbecile
    dumb fool jerk bastard dipshit asshole
    idioten trottel abschaum dummkopf arschloch
    imbécile connard crétin salaud abruti
    imbécil estúpido estúpida basura escoria""".split()
THREATS = """kill hurt destroy murder shoot stab beat burn
    töten umbringen verprügeln erschießen
    tuer frapper détruire
    matar golpear destruir""".split()

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
CLOSED = {TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
REACH = 3  # words after a negation that it still covers
SEED_STRENGTH = 0.9  # of a listed word that the labels do not know

# A state's weight before any label: an insult, a threat, and what the state makes of it.
PRIOR = {INSULT: 0.75, THREAT: 0.15}
TARGETED = {INSULT: 1.2, THREAT: 4.0}
NEGATED = REPORTED = 0.35
PRIOR_CLAUSES = 20  # as many labelled clauses the prior weight of a state is worth

# The learning sample: at most so many documents of either label, those with the smallest hashes of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
PREFIXES = (4, 5, 6)  # a term is a word, or a beginning of this length of a longer one
LONGEST = 40  # longer words are no terms
MAX_TERMS = 50_000  # terms whose places are counted, those in the most toxic documents
LEAST_STRENGTH = 0.6  # the lower bound of a learned term's strength
MAX_KNOWN = 500_000  # words whose class a worker remembers
FLUSH = 400_000  # terms a worker counts before it hands them on

CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")


def _negation(state: int, symbol: int) -> int:
    return REACH if symbol == NEGATION else max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    return 1 if symbol == REPORT else state


def _target(state: int, symbol: int) -> int:
    return 1 if symbol == TARGET else state


def compose(*machines: tuple[int, object]) -> tuple[dict[tuple, int], list[list[int]]]:
    """The product of machines, each (number of states, step): the number of each joint state, and the next by symbol."""
    states = list(itertools.product(*[range(n) for n, _ in machines]))
    number = {s: i for i, s in enumerate(states)}
    steps = [
        [number[tuple(step(part, symbol) for part, (_, step) in zip(s, machines, strict=True))] for symbol in range(THREAT + 1)]
        for s in states
    ]
    return number, steps


NUMBER, NEXT = compose((REACH + 1, _negation), (2, _report), (2, _target))
# What a joint state means for an insult or threat: whether it is negated, reported, targeted.
MEANING = [(negation > 0, report > 0, target > 0) for negation, report, target in NUMBER]
SPOKEN = [(kind, *m) for kind in (INSULT, THREAT) for m in itertools.product((False, True), repeat=3)]


def prior_weight(kind: int, negated: bool, reported: bool, targeted: bool) -> float:
    weight = PRIOR[kind] * (TARGETED[kind] if targeted else 1)
    return weight * (NEGATED if negated else 1) * (REPORTED if reported else 1)


@dataclass(frozen=True)
class Grammar:
    """The terms with their kind and strength (a term ending in ``*`` is a beginning), the states' weights, the rest."""

    terms: dict[str, tuple[int, float]]
    weights: dict[tuple, float]
    unmatched: float

    @staticmethod
    def listed() -> Grammar:
        """The grammar that no label has changed."""
        terms = {w: (INSULT, SEED_STRENGTH) for w in INSULTS} | {w: (THREAT, SEED_STRENGTH) for w in THREATS}
        return Grammar(terms, {s: prior_weight(*s) for s in SPOKEN}, 0.05)


def _terms_of(word: str) -> list[str]:
    """The word, and its beginnings."""
    if len(word) > LONGEST:
        return []
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


class _Lexicon(dict):
    """A word's number in ``entries`` (symbol, strength); 0 is any other word.  Found once per word."""

    def __init__(self, grammar: Grammar) -> None:
        super().__init__()
        self.grammar = grammar
        self.entries = [(OTHER, 0.0), *[(symbol, 0.0) for symbol in CLOSED]]
        self.closed = {w: symbol for symbol, words in CLOSED.items() for w in words}

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_KNOWN:
            self.clear()
        found = [self.grammar.terms[t] for t in _terms_of(word) if t in self.grammar.terms]
        if found:
            self.entries.append(max(found, key=lambda e: e[1]))
            code = len(self.entries) - 1
        else:
            code = self.closed.get(word, 0)
        self[word] = code
        return code


def spoken(text: str, lexicon: _Lexicon) -> Iterator[list[tuple[tuple, float]]]:
    """For each clause with an insult or threat: their states and strengths, in order."""
    for clause in CLAUSE.finditer(text.lower()):
        codes = [lexicon[w] for w in WORD.findall(clause.group())]
        if not codes or max(codes) <= REPORT:
            continue
        # Somebody may be addressed after the insult too, so the clause is asked for a target first.
        state = NUMBER[0, 0, int(TARGET in codes)]
        said = []
        for code in codes:
            symbol, strength = lexicon.entries[code]
            if symbol >= INSULT:
                said.append(((symbol, *MEANING[state]), strength))
            state = NEXT[state][symbol]
        yield said


def score_text(text: str, grammar: Grammar, lexicon: _Lexicon) -> float:
    """The probability that some clause is toxic: a clause is as toxic as the worst in it, clauses err independently."""
    clean = 1 - grammar.unmatched
    for said in spoken(text, lexicon):
        clean *= 1 - max(strength * grammar.weights[state] for state, strength in said)
    return 1 - clean


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


_DOC_COUNTS = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents each term is."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        terms = list(counts[0] | counts[1])
        found = {"term": terms, "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]}
        return _batch(found, _DOC_COUNTS)

    for batch in batches:
        bodies = batch.column("body")
        for i, toxic in enumerate(batch.column("toxic").to_pylist()):
            words = set(WORD.findall(bodies[i].as_py().lower()))
            counts[toxic].update({t for w in words for t in _terms_of(w)})
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield rows()
                counts = (Counter(), Counter())
    yield rows()


_PLACES = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("place", pa.string())])


def _places(terms: frozenset[str]):
    """The different places of each of the terms, by label: the words before and after a word, the words of a beginning."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            bodies = batch.column("body")
            for i, toxic in enumerate(batch.column("toxic").to_pylist()):
                words = ["", *WORD.findall(bodies[i].as_py().lower()), ""]
                for k in range(1, len(words) - 1):
                    for t in _terms_of(words[k]):
                        if t in terms:
                            found.add((t, toxic, words[k] if t[-1] == "*" else f"{words[k - 1]} {words[k + 1]}"))
            term, toxic, place = zip(*found, strict=True) if found else ((), (), ())
            yield _batch({"term": list(term), "toxic": list(toxic), "place": list(place)}, _PLACES)

    return find


_STATES = pa.schema([("state", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def _states(grammar: Grammar):
    """How many matched clauses each state has by label; state -1: documents without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = _Lexicon(grammar), Counter()
        number = {s: i for i, s in enumerate(SPOKEN)}
        for batch in batches:
            bodies = batch.column("body")
            for i, toxic in enumerate(batch.column("toxic").to_pylist()):
                matched = False
                for said in spoken(bodies[i].as_py(), lexicon):
                    matched = True
                    state, _ = max(said, key=lambda s: s[1] * grammar.weights[s[0]])
                    counts[number[state], toxic] += 1
                if not matched:
                    counts[-1, toxic] += 1
        keys = list(counts)
        found = {"state": [s for s, _ in keys], "toxic": [t for _, t in keys], "n": [counts[k] for k in keys]}
        yield _batch(found, _STATES)

    return count


def _sample(docs: DataFrame, labels: DataFrame, training: Column, doc_id: str, text: str, label: str) -> tuple[DataFrame, float]:
    """The bounded learning sample (``body``, ``toxic``), and how many clean documents each sampled one stands for."""
    ids = labels.select(labels[doc_id].cast("long").alias("doc"), labels[label].cast("int").alias("toxic"))
    ids = ids.filter(training & F.col("doc").isNotNull() & F.col("toxic").isin(0, 1))
    ids = ids.groupBy("doc").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc")
    chosen = ids.filter("toxic = 1").orderBy(order, "doc").limit(SAMPLE_TOXIC)
    chosen = chosen.unionByName(ids.filter("toxic = 0").orderBy(order, "doc").limit(SAMPLE_CLEAN))
    bodies = docs.select(docs[doc_id].cast("long").alias("doc"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids, so they are safe to broadcast; repeated ids count once.
    texts = bodies.join(F.broadcast(chosen), "doc").groupBy("doc").agg(F.min("body").alias("body"), F.max("toxic").alias("toxic"))
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    weight = max(1.0, clean / SAMPLE_CLEAN) / max(1.0, toxic / SAMPLE_TOXIC)
    return stored(texts.select("body", "toxic")), weight


def learn(sample: DataFrame, weight: float) -> Grammar:
    """The grammar that the labelled documents (``body``, ``toxic``) support; a clean one counts ``weight`` times.

    A term's strength is the share of its places that lie in toxic documents.  A word's place is the word before and
    after it, a beginning's place is the word that it begins, each counted once for each label.  So copies of a
    document say nothing new, terms that only one group of near copies has stay weak, and a beginning needs many
    words of its own.  Terms are kept whose strength is high beyond chance.  Then the clauses they match
    are counted by state, and the states' weights follow from the counts and the prior.
    """
    start = Grammar.listed()
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return start
    counts = sample.mapInArrow(_document_counts, "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = F.col("toxic") * clean >= 4 * F.col("clean") * toxic
    asked = counts.filter((F.col("toxic") >= 3) & often).orderBy(F.desc("toxic"), "term").limit(MAX_TERMS)
    terms = frozenset(r.term for r in asked.select("term").collect()) | frozenset(start.terms)
    places = sample.mapInArrow(_places(terms), "term string, toxic int, place string").distinct()
    found: dict[str, list[int]] = {}
    for r in places.groupBy("term", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(r.term, [0, 0])[r.toxic] = r.n
    base = toxic / (toxic + clean * weight)
    learned = dict(start.terms)
    for term, (b, a) in found.items():
        kind, known = start.terms.get(term, (INSULT, base))
        worth = 10 if term in start.terms else 3
        n = a + b * weight + worth
        strength = (a + worth * known) / n
        sure = strength - 1.64 * (strength * (1 - strength) / n) ** 0.5
        if term in start.terms or sure >= LEAST_STRENGTH:
            learned[term] = (kind, strength)
    grammar = Grammar(learned, start.weights, start.unmatched)
    states = sample.mapInArrow(_states(grammar), "state int, toxic int, n long")
    seen = {(r.state, r.toxic): r.n for r in states.groupBy("state", "toxic").agg(F.sum("n").alias("n")).collect()}

    def share(state: int, prior: float, worth: float) -> float:
        t, c = seen.get((state, 1), 0), seen.get((state, 0), 0) * weight
        return (t + worth * prior) / (t + c + worth)

    weights = {s: share(i, prior_weight(*s), PRIOR_CLAUSES) for i, s in enumerate(SPOKEN)}
    return Grammar(learned, weights, min(0.45, share(-1, base, 2)))


def _scored(grammar: Grammar, text: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(grammar)
        for batch, texts in row_slices(batches, text):
            scores = [score_text(texts[i].as_py() or "", grammar, lexicon) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["row", "score"])

    return score


def in_training(doc_id: Column, parts: int = 5, held_out: int = 0) -> Column:
    """Whether a label is learned from: its document id's CRC-32 modulo ``parts`` is not ``held_out`` (a NULL id: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != held_out


def score_toxicity(
    docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5
) -> DataFrame:
    """The documents with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    ``labels`` has ids and labels 0 or 1; those ``in_training`` of their id are learned from, on a sample of at most
    ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents.  Only the text goes into a score.  Without labels of both kinds the
    listed words and prior weights hold.

    A NULL text is an empty one; a text without a matched clause gets the share of toxic ones among such texts.
    Repeated rows are scored each; an id with labels of both kinds counts as toxic, labels without id or with another
    value are ignored.  An empty table gives an empty result.  A caller's column with the name of an added one is
    replaced.  The grammar has at most ``MAX_TERMS`` learned terms, so it goes to the workers with the task.
    """
    grammar = Grammar.listed()
    if labels is not None:
        grammar = learn(*_sample(docs, labels, in_training(F.col("doc")), doc_id, text, label))
    rows = whole_rows(docs)
    schema = rows.withColumn("score", F.lit(None).cast("double")).schema
    scored = rows.mapInArrow(_scored(grammar, text), schema)
    added = {
        "held_out": ~in_training(F.col("row").getField(doc_id)),
        "score": F.col("score"),
        "predicted": (F.col("score") >= threshold).cast("int"),
    }
    return unpacked(scored, docs.columns, added)
