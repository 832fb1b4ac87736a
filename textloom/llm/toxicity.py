"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, person, referent, negation, reported speech, quotation mark, boundary, other). Five transducers
are composed, each reading what the one before writes: negation and reported speech mark the insults and threats in their reach,
target marks the end of a clause that names a person, speaks of something definite, says what is, or piles insults up, threat and insult remember the strongest of
theirs and write one label for the clause at its end. The composition is one deterministic table, and so are the weights of its arcs.

A match is a clause with an insult and a target, or a threat and a person; an insult or a threat without a target is none. A clause's score is the sum of its
words' weights, each times the weight of the arcs it takes: an insult that is negated, quoted or spoken of as a word is worth a tenth, one aimed at
a person half as much again. A document is scored by the sum of its clauses, as such and for its length, and by nothing else. Function
words of the grammar and weights of arcs are fixed; the insult lexicon (words and stems) and the weights of both sums are learned from labelled documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, one_each, slices, table, texts_of

#: Labelled documents that are sampled at most, by label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Candidate terms that are looked at, least documents and contexts of a candidate, and its largest share of clean documents.
CANDIDATES, LEAST_DOCS, LEAST_CONTEXTS, MOST_CLEAN = 4000, 2, 5, 0.05
#: A term of no clean document that stands between so many different neighbours (of 64 hashed ones) is an insult without further proof.
SURE_CONTEXTS = 48
#: One that explains a single document more must at least stand between so many.
LONE_CONTEXTS = 8
#: Lengths of the prefixes of longer words that may become stems.
STEMS = range(4, 9)
MEMO = 1 << 17
SHORT = 50
#: Weight of a threat, and of an insult that wasn't learned.
THREAT_WEIGHT, INSULT_WEIGHT = 3.0, 3.0
HELD_OUT_PARTS, HELD_OUT = 4, 2

# Function words of the grammar in English, German, French and Spanish.
TARGETS = "you your you're u they he she him her them their du dich dir ihr euch er tu toi te vous votre ton ta il elle ils elles tú ti usted ustedes vosotros ella ellos".split()
REFERENTS = "the this that these those it its is are was were der die das den dem des dieser diese dieses ist sind war le la les ce cet cette ces est sont était el los las este esta ese esa es son era".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't won't nicht kein keine keinen nie niemals pas jamais aucun non nunca jamás ni".split()
REPORTS = "said says say quoted claims claimed wrote writes reported called calls word words term phrase means sagte sagt schrieb wort begriff heißt dit disait écrit mot terme signifie dijo dice escribió palabra término significa".split()
THREATS = "kill hurt destroy beat stab shoot strangle burn töten umbringen verletzen schlagen tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot moron stupid loser scum pathetic worthless disgusting trash clown".split()
#: Weights of arcs: of a negated or reported word, and of a clause aimed at a person.
SLIGHT, POINTED = 0.1, 1.5

#: Symbols that text is read as.
OTHER, BREAK, QUOTE, INSULT, THREAT, TARGET, REFERENT, NEGATION, REPORT = range(9)
#: Symbols that transducers write for each other: marked words, and clause ends that know more.
NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT, DEFINITE_END, AIMED_END, NEGATED_END, REPORTED_END, THREAT_END = range(9, 18)
#: Labels of clauses, which the last one writes.
LABELS = ("definite", "aimed", "negated", "reported", "threat")
DEFINITE, AIMED, NEGATED, REPORTED, THREATENED = range(18, 23)
READ = REPORT + 1
_FIXED = {w: s for words, s in ((INSULTS, INSULT), (THREATS, THREAT), (REPORTS, REPORT), (NEGATIONS, NEGATION), (REFERENTS, REFERENT), (TARGETS, TARGET)) for w in words}
_MARKS = {c: BREAK for c in ".!?;\n"} | {c: QUOTE for c in '"“”«»„'}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n\"“”«»„]")


class Transducer:
    """States from 0; an arc (state, symbol) -> (state, symbol written) and its weight, 1 unless it is given. A symbol without an arc keeps the state and is passed on."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int]], weights: dict[tuple[int, int], float] | None = None) -> None:
        self.arcs, self.weights = arcs, weights or {}

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return *self.arcs.get((state, symbol), (state, symbol)), self.weights.get((state, symbol), 1.0)


def negation(reach: int = 3) -> Transducer:
    """States 1 to ``reach``: so many words more are negated."""
    arcs: dict = {(s, NEGATION): (reach, OTHER) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x) for x in (OTHER, TARGET, REFERENT, REPORT)} | {(s, INSULT): (s - 1, NEGATED_INSULT), (s, THREAT): (s - 1, NEGATED_THREAT), (s, BREAK): (0, BREAK)}
    return Transducer(arcs, {(s, x): SLIGHT for s in range(1, reach + 1) for x in (INSULT, THREAT)})


def reported() -> Transducer:
    """State 1: a speech word has come; 2: its quotation is open. A clause's end closes 1 only."""
    arcs: dict = {(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER), (2, REPORT): (2, OTHER), (0, QUOTE): (0, OTHER), (1, QUOTE): (2, OTHER), (2, QUOTE): (0, OTHER), (1, BREAK): (0, BREAK)}
    marked = {(s, x): (s, y) for s in (1, 2) for x, y in ((INSULT, REPORTED_INSULT), (THREAT, REPORTED_THREAT))}
    return Transducer(arcs | marked, dict.fromkeys(marked, SLIGHT))


def target() -> Transducer:
    """State 2: the clause has spoken of something definite or said what is, 3: of a person, before or after the rest. A second insult says whom the
    first one means ("worthless clown"); state 1: one has come."""
    arcs = {(s, TARGET): (3, OTHER) for s in range(4)} | {(s, REFERENT): (max(s, 2), OTHER) for s in range(4)} | {(0, INSULT): (1, INSULT), (1, INSULT): (2, INSULT)}
    return Transducer(arcs | {(1, BREAK): (0, BREAK), (2, BREAK): (0, DEFINITE_END), (3, BREAK): (0, AIMED_END)}, {(3, BREAK): POINTED})


def _strongest(symbols: tuple[int, int, int]) -> dict:
    """States 0 to 3: the clause has none, a negated, a reported, a plain one of these words at best."""
    return {(s, x): (max(s, k), OTHER) for s in range(4) for k, x in enumerate(symbols, 1)}


def threat() -> Transducer:
    """A threat needs a person to aim at in its clause."""
    arcs = _strongest((NEGATED_THREAT, REPORTED_THREAT, THREAT))
    ends = {(s, x): (0, x) for s in range(4) for x in (BREAK, DEFINITE_END)}
    return Transducer(arcs | ends | {(s, AIMED_END): (0, (AIMED_END, NEGATED_END, REPORTED_END, THREAT_END)[s]) for s in range(4)})


def insult() -> Transducer:
    """Writes the label of a clause at its end; an end without a target, an insult or a threat stays a boundary."""
    arcs = _strongest((NEGATED_INSULT, REPORTED_INSULT, INSULT)) | {(s, BREAK): (0, BREAK) for s in range(4)}
    for end, known, most in ((DEFINITE_END, 0, DEFINITE), (AIMED_END, 0, AIMED), (NEGATED_END, 1, AIMED), (REPORTED_END, 2, AIMED)):
        arcs |= {(s, end): (0, (BREAK, NEGATED, REPORTED, most)[max(s, known)]) for s in range(4)}
    return Transducer(arcs | {(s, THREAT_END): (0, THREATENED) for s in range(4)})


MACHINES = (negation(), reported(), target(), threat(), insult())


class Grammar:
    """The composition of transducers: from a state and a symbol, the next state, what the last one writes, and the product of the arcs' weights."""

    def __init__(self, machines: tuple[Transducer, ...] = MACHINES) -> None:
        start = (0,) * len(machines)
        number, todo = {start: 0}, [start]
        self.next: list[list[int]] = []
        self.writes: list[list[int]] = []
        self.weights: list[list[float]] = []
        #: Whether the clause has named a person so far.
        self.aimed: list[bool] = []
        for states in todo:
            ahead, out, weights = [], [], []
            self.aimed.append(any(m.weights.get((s, BREAK), 1.0) == POINTED for m, s in zip(machines, states, strict=True)))
            for symbol in range(READ):
                to, weight = [], 1.0
                for machine, state in zip(machines, states, strict=True):
                    state, symbol, w = machine.step(state, symbol)
                    to.append(state)
                    weight *= w
                if (key := tuple(to)) not in number:
                    number[key] = len(number)
                    todo.append(key)
                ahead.append(number[key])
                out.append(symbol)
                weights.append(weight)
            self.next.append(ahead)
            self.writes.append(out)
            self.weights.append(weights)

    def clauses(self, read: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """(label, score) of each clause that matches, from (symbol, weight) of its words. Threats count where their clause is aimed."""
        state, insults, threats, out = 0, 0.0, 0.0, []
        for symbol, w in [*read, (BREAK, 0.0)]:
            if symbol == INSULT:
                insults += w * self.weights[state][symbol]
            elif symbol == THREAT:
                threats += w * self.weights[state][symbol]
            elif symbol == BREAK:
                if (label := self.writes[state][symbol] - DEFINITE) >= 0:
                    out.append((label, (insults + threats * self.aimed[state]) * self.weights[state][symbol]))
                insults = threats = 0.0
            state = self.next[state][symbol]
        return out


GRAMMAR = Grammar()


class Lexicon(dict):
    """Token -> (symbol, weight), from fixed function words and learned insult terms (a trailing * marks a stem)."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.terms = terms
        self.words = {w: INSULT_WEIGHT for w in INSULTS} | {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= MEMO:
            self.clear()
        if token in _MARKS:
            found = _MARKS[token], 0.0
        elif token in self.words:
            found = INSULT, self.words[token]
        elif token in _FIXED:
            found = _FIXED[token], THREAT_WEIGHT * (_FIXED[token] == THREAT)
        else:
            weight = max((self.stems[token[:n]] for n in STEMS if len(token) > n and token[:n] in self.stems), default=None)
            found = (OTHER, 0.0) if weight is None else (INSULT, weight)
        self[token] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """log(1 + sum of the scores of all clauses that match), and the same for the sum a hundred words; shorter texts count as ``SHORT`` words."""
    read = list(map(lexicon.__getitem__, _TOKEN.findall(text.lower())))
    if not any(symbol in (INSULT, THREAT) for symbol, _ in read):
        return [0.0, 0.0]
    total = math.fsum(score for _, score in GRAMMAR.clauses(read))
    return [math.log1p(total), math.log1p(100 * total / max(SHORT, len(read)))]


N_FEATURES = 2
#: Weights (bias last) without any label to learn from.
PRIOR = [1.0, 1.0, -2.5]


def _terms(tokens: list[str]) -> Iterator[tuple[str, int]]:
    """Terms of a document with a bit for the neighbours that each stands between: words and, of longer words, stems."""
    padded = ["", *(t if t not in _MARKS else "" for t in tokens), ""]
    for i, t in enumerate(padded[1:-1], 1):
        if len(t) < 3:
            continue
        bit = xxhash.xxh32_intdigest(f"{padded[i - 1]} {padded[i + 1]}") & 63
        yield t, bit
        for n in STEMS:
            if len(t) > n:
                yield t[:n] + "*", bit


_TERM = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64()), ("pos_times", pa.int64()), ("neg_times", pa.int64()), ("bits", pa.int64())])


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of every term of labelled documents, whatever the batches: their sums alone say which are candidates."""
    for b in slices(batches, 0):
        n: tuple[Counter, Counter] = (Counter(), Counter())
        times: tuple[Counter, Counter] = (Counter(), Counter())
        bits: dict[str, int] = {}
        for raw, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own: set[str] = set()
            for t, bit in _terms(_TOKEN.findall(raw.decode("utf-8", "replace").lower())):
                own.add(t)
                times[label][t] += 1
                if label:
                    bits[t] = bits.get(t, 0) | 1 << bit
            n[label].update(own)
        terms = list(n[0] | n[1])
        signed = [x - (1 << 64) if (x := bits.get(t, 0)) >> 63 else x for t in terms]
        yield table(_TERM, [terms, [n[1][t] for t in terms], [n[0][t] for t in terms], [times[1][t] for t in terms], [times[0][t] for t in terms], signed])


_HITS = pa.schema([("hits", pa.list_(pa.int32()))])


def _hit_batches(index: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 0):
        hits = [sorted({index[t] for t, _ in _terms(_TOKEN.findall(raw.decode("utf-8", "replace").lower())) if t in index}) for raw in b.column(0).to_pylist()]
        yield table(_HITS, [hits])


_FEATURED = pa.schema([("label", pa.int32()), ("f", pa.list_(pa.float64()))])


def _feature_batches(terms: dict[str, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(terms)
    for b in slices(batches, 0):
        yield table(_FEATURED, [b.column(1), [features(raw.decode("utf-8", "replace"), lexicon) for raw in b.column(0).to_pylist()]])


def cover(candidates: list[tuple[str, int, int, int]], hits: list[list[int]], share: float, least_gain: int = 2) -> list[int]:
    """Greedy cover of toxic documents by candidate terms (term, toxic documents, clean documents, contexts): the fewest terms that
    explain the labels, less twice those that clean documents would give by chance
    (``share``: toxic documents for each clean one). A rare word of a copied toxic text is not chosen, for a true insult in the same
    text explains it already."""
    owners: list[set[int]] = [set() for _ in candidates]
    for d, own in enumerate(hits):
        for c in own:
            owners[c].add(d)
    sure = sorted((c for c, (_, _, clean, contexts) in enumerate(candidates) if not clean and contexts >= SURE_CONTEXTS), key=lambda c: -len(candidates[c][0]))
    chosen: list[int] = []
    for c in sure:  # a stem that is no more common than a longer term says no more than that
        stem = candidates[c][0].rstrip("*")
        if not any(candidates[x][0].startswith(stem) and candidates[x][1] >= 0.9 * candidates[c][1] for x in chosen):
            chosen.append(c)
    open_ = set(range(len(hits))).difference(*(owners[c] for c in chosen))

    def worth(c: int) -> tuple:
        term, toxic, clean, contexts = candidates[c]
        return len(owners[c] & open_) - 2 * share * clean, contexts, toxic, len(term), term

    while open_ and candidates:
        best = max(range(len(candidates)), key=worth)
        gain, contexts = worth(best)[:2]
        if gain < (1 if contexts >= LONE_CONTEXTS else least_gain):
            break
        chosen.append(best)
        open_ -= owners[best]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) by Newton steps on the ridge-penalised mean log loss."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty, x.T @ (p - y) / len(x) + penalty @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(docs: DataFrame, labels: DataFrame, column: str, usable: F.Column, caps: dict[int, int]) -> DataFrame:
    """(text, label) of at most ``caps[label]`` rows of each label, those of the smallest id hashes; equal texts count once, and of texts under
    one id one counts, so that a repeated id has no larger share."""
    own = labels.where(usable & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    picked = [own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in caps.items()]
    chosen = picked[0]
    for p in picked[1:]:
        chosen = chosen.unionByName(p)
    texts = one_each(texts_of(docs).join(F.broadcast(chosen), "doc_id"), "label")
    return texts.groupBy("digest").agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, pos, neg, pos_times, neg_times, contexts) of every term of (text, label) rows: documents and occurrences by label, hashed neighbours in toxic ones."""
    terms = sample.mapInArrow(_term_batches, "term string, pos long, neg long, pos_times long, neg_times long, bits long").groupBy("term")
    return terms.agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_times", "neg_times")], F.expr("bit_count(bit_or(bits))").alias("contexts"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """(insult terms with weights, weights of the features), from labelled documents outside the held-out fold."""
    sample = sampled(docs, labels, "toxic", fold("doc_id", HELD_OUT_PARTS) != HELD_OUT, {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN})
    sample = materialise(sample, "toxic-sample")
    n = dict(sample.groupBy("label").count().collect())
    if not n.get(1) or not n.get(0):
        return {}, PRIOR
    terms = term_counts(sample).where((F.col("pos") >= LEAST_DOCS) & (F.col("contexts") >= LEAST_CONTEXTS) & (F.col("neg_times") * n[1] <= MOST_CLEAN * F.col("pos_times") * n[0]))
    rows = terms.orderBy(F.desc("contexts"), F.desc("pos"), "term").limit(CANDIDATES).collect()
    found = [(r["term"], r["pos"], r["neg"], r["contexts"]) for r in rows]
    odds = {r["term"]: math.log((r["pos_times"] + 0.5) / (n[1] + 1) * (n[0] + 1) / (r["neg_times"] + 0.5)) for r in rows}
    index = {c[0]: i for i, c in enumerate(found)}
    hits = [r["hits"] for r in sample.where("label = 1").mapInArrow(partial(_hit_batches, index), "hits array<int>").collect()]
    weights = {found[c][0]: max(0.5, odds[found[c][0]]) for c in cover(found, hits, n[1] / n[0])}
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows, sorted so that sums of floats don't depend on how rows were dealt.
    rows = sorted(sample.mapInArrow(partial(_feature_batches, weights), "label int, f array<double>").collect())
    x, y = np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows], float)
    return weights, logistic(x, y).tolist()


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("matches", pa.int64()), ("text_sha256", pa.string())])


def _score_batches(terms: dict[str, float], weights: list[float], keyed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon, w = Lexicon(terms), np.array(weights)
    for b in slices(batches, 1):
        x = np.array([features(t.decode("utf-8", "replace"), lexicon) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
        digests = [hashlib.sha256(t).hexdigest() if keyed else None for t in b.column(1).to_pylist()]
        yield table(_SCORES, [b.column(0), 1 / (1 + np.exp(-np.clip((x * w[:-1]).sum(1) + w[-1], -30, 30))), (x[:, 0] > 0).astype(int), digests])


def score(docs: DataFrame, labels: DataFrame, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3), matches (1 if any clause matched) and, if ``keyed``, text_sha256.

    A null or empty text gets the score of a text without a match. A null doc_id stays null, as does its held_out. Repeated rows each
    come back; other columns are ignored; an empty table gives no rows. Without labels of both kinds a fixed lexicon and weights serve.
    """
    terms, weights = train(docs, labels)
    texts = texts_of(docs)
    out = texts.mapInArrow(partial(_score_batches, terms, weights, keyed), "doc_id long, score double, matches long, text_sha256 string")
    return out.select("doc_id", (fold("doc_id", HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "matches", *["text_sha256"] * keyed)
