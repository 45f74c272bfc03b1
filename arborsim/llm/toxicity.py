"""Toxicity by a weighted finite-state grammar of clauses.

A lexical transducer reads the words of a clause as classes (insult, threat, target, negation, reported speech,
break, other); a word that insults or threatens may also be read as an ordinary one, at no weight. Three
weighted transducers, composed into one machine, read the classes and rewrite them: negation marks the words it
governs (the next ``SCOPE``, up to a break), target marks insults that follow it and turns a threat that reaches
it into a hit, reported speech marks all that follows a word of saying. Every arc has a weight; the weight of a
clause is that of its best path, the sum of its words' and marks' weights, so a denied insult is best read as no
insult at all. Only clauses in which an insult or a threat occurs are walked; isolated words have no say.

Insult words are a list of fixed values and words and word beginnings learned from labels: those whose document
frequency differs most between toxic and other rows, each with its log odds as weight. The marks' weights are
the log odds of documents all of whose insults or threats have the mark against those with plain insults only,
drawn towards the values in ``MARKS`` where such documents are few. Clause weights are summed up for a document
and a logistic curve, fitted on other labelled rows, gives the score. The fit uses at most ``max_rows`` labelled
rows, those of the least hashes of their id and never held out.

Null and empty texts score as texts without matches. Without labels the curve falls back to a fixed one. Very
long texts are read once, clause by clause. Repeated rows and clashing columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common
from arborsim.llm.logistic import Logistic

#: Bound on the labelled rows a fit may use.
MAX_ROWS = 9000
#: Common words of each class in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum clown worthless pathetic trash garbage disgusting jerk fool imbecile vermin filth bastard coward pig liar dummkopf arschloch abschaum versager trottel connard imbécile ordure minable crétin basura imbécil estúpido inútil escoria".split()
THREATS = "kill hurt destroy beat shoot stab burn murder attack töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours youre youve youll he she they them him her u du dich dir euch ihr sie tu toi te vous ton ta tú ti usted ustedes".split()
NEGATIONS = "not never no nobody nor without aint arent cant cannot couldnt didnt doesnt dont hadnt hasnt havent isnt mustnt neednt shouldnt wasnt werent wont wouldnt nicht kein keine keinen nie niemals pas jamais ne non nunca jamás ni sin".split()
REPORTS = "said says say saying call calls called wrote quoted quotes claimed claims told reported sagte sagt nannte nennt schrieb dit disait appelé écrit dijo llamó llaman escribió".split()
BREAKS = "but however though although yet aber doch jedoch mais pourtant pero sino".split()

CLAUSE = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
I, V, T, N, R, B, O = CLASSES = "IVTNRBO"
#: Words that a negation governs, and words from a threat to the target that it reaches.
SCOPE, REACH = 4, 3
#: Weights of the marks before labels say otherwise: aimed at a target, a hit, denied, reported.
MARKS = {"a": 0.5, "H": 4.0, "-": -8.0, "r": -2.0}
#: So many documents with a mark weigh as much as its value in MARKS.
TRUST = 50


class Transducer:
    """Letter by letter: arcs[state, symbol] = [(output, weight, next state)]; any state may be the last."""

    def __init__(self, start, arcs: dict[tuple, list[tuple[str, float, object]]]):
        self.start, self.arcs = start, arcs

    def compose(self, other: Transducer) -> Transducer:
        """Reads as self does and writes what other makes of self's output; states are pairs, weights sums."""
        inputs, todo, arcs = sorted({x for _, x in self.arcs}), [(self.start, other.start)], {}
        seen = set(todo)
        while todo:
            p, q = todo.pop()
            for x in inputs:
                out = [(z, u + v, (p2, q2)) for y, u, p2 in self.arcs.get((p, x), ()) for z, v, q2 in other.arcs.get((q, y), ())]
                if out:
                    arcs[(p, q), x] = out
                for _, _, s in out:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
        return Transducer((self.start, other.start), arcs)

    def best(self, words: list[list[tuple[str, float]]]) -> tuple[float, tuple[str, ...]]:
        """Weight and output of the best path for a sequence of words, each with its (class, weight) readings."""
        at = {self.start: (0.0, ())}
        for readings in words:
            after: dict = {}
            for state, (w, out) in at.items():
                for x, u in readings:
                    for y, v, s in self.arcs.get((state, x), ()):
                        if s not in after or w + u + v > after[s][0]:
                            after[s] = (w + u + v, (out, y))
            at = after
        if not at:
            return -np.inf, ()
        weight, chain = max(at.values(), key=lambda x: x[0])
        out = []
        while chain:
            chain, y = chain
            out.append(y)
        return weight, tuple(reversed(out))


def negation(w: dict[str, float]) -> Transducer:
    """The state counts the words that are still governed."""
    after = lambda k, x: SCOPE if x == N else 0 if x == B else max(0, k - 1)
    return Transducer(0, {(k, x): [(x + "-", w["-"], after(k, x)) if k and x in (I, V) else (x, 0.0, after(k, x))] for k in range(SCOPE + 1) for x in CLASSES})


def target(w: dict[str, float]) -> Transducer:
    """The state: whether a target was met, words for which a threat can still reach one, whether that is denied."""
    arcs: dict = {}
    for met in (False, True):
        for wait, denied in [(0, False), *((k, d) for k in range(1, REACH + 1) for d in (False, True))]:
            on = (met, wait - 1, denied and wait > 1) if wait else (met, 0, False)
            here = met, wait, denied
            for x in (N, R, O):
                arcs[here, x] = [(x, 0.0, on)]
            arcs[here, I] = [(I + "a", w["a"], on) if met else (I, 0.0, on)]
            arcs[here, I + "-"] = [(I + "-", 0.0, on)]
            for x in (V, V + "-"):
                arcs[here, x] = [(x, 0.0, (met, REACH, x != V))]
            arcs[here, T] = [(("H-", 0.0) if denied else ("H", w["H"])) + ((True, 0, False),)] if wait else [(T, 0.0, (True, 0, False))]
            arcs[here, B] = [(B, 0.0, (met, 0, False))]
    return Transducer((False, 0, False), arcs)


def reported(w: dict[str, float]) -> Transducer:
    said = [I, I + "a", I + "-", V, V + "-", "H", "H-"]
    plain = [T, N, O, B]
    arcs = {(s, x): [(x, 0.0, s)] for s in (0, 1) for x in plain} | {(s, R): [(R, 0.0, 1)] for s in (0, 1)}
    return Transducer(0, arcs | {(0, x): [(x, 0.0, 0)] for x in said} | {(1, x): [(x + "r", 0.0 if x[0] == V else w["r"], 1)] for x in said})


def grammar(w: dict[str, float]) -> Transducer:
    return negation(w).compose(target(w)).compose(reported(w))


class ToxicityModel:
    """Fitted state: words and marks with their weights, and a curve."""

    def __init__(self, most_learned: int = 256):
        self.most, self.prior = most_learned, 0.1
        self.words = {w: 1.0 for w in INSULTS}
        self.stems: dict[str, float] = {}
        self.marks = dict(MARKS)
        self.curve: Logistic | None = None

    def learn(self, rows: list[tuple[str, int]]) -> ToxicityModel:
        ys = [y for _, y in rows]
        if not rows or not 0 < sum(ys) < len(ys):
            return self
        self.prior = float(np.mean(ys))
        half = len(rows) * 3 // 5
        lexicon, fit = rows[:half], rows[half:]
        n1 = sum(y for _, y in lexicon)
        n0, sets = len(lexicon) - n1, [(set(WORD.findall(t.lower())), y) for t, y in lexicon]

        def telling(terms) -> tuple[dict[str, float], Counter]:
            pos, neg, found = Counter(), Counter(), []
            for words, y in sets:
                (pos if y else neg).update(terms(words))
            for w, a in pos.items():
                p, q = (a + 0.5) / (n1 + 1), (neg[w] + 0.5) / (n0 + 1)
                z = (p - q) / np.sqrt(p * (1 - p) / (n1 + 1) + q * (1 - q) / (n0 + 1) + 1e-12)
                if a >= 5 and z > 4 and p > 4 * q:
                    found.append((z, w, float(np.log(p / q))))
            return {w: weight for _, w, weight in sorted(found, reverse=True)[: self.most]}, pos + neg

        learned, seen = telling(lambda words: words)
        # a beginning counts when it tells more than its words alone: it must go on in several ways
        stems, _ = telling(lambda words: {w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k})
        ways: dict[str, set[str]] = {}
        for words, y in sets:
            for w in words if y else ():
                for k in (4, 5, 6, 7):
                    if w[:k] in stems:
                        ways.setdefault(w[:k], set()).add(w)
        self.stems = {w: x for w, x in stems.items() if len(ways.get(w, ())) >= 5}
        # a listed word that the labels don't bear out keeps little weight
        self.words = {w: (1.0 if seen[w] < 5 else 0.2) for w in INSULTS} | learned
        self._weigh(lexicon)
        x = self.features([t for t, _ in fit])
        if len(fit) and 0 < sum(y for _, y in fit) < len(fit):
            self.curve = Logistic().fit(x, np.array([y for _, y in fit]))
        return self

    def _weigh(self, rows: list[tuple[str, int]]) -> None:
        """Weights of the marks, from what documents with each of them are labelled."""
        found: dict[str, list[int]] = {m: [0, 0] for m in ("", *MARKS)}
        for text, y in rows:
            said = [o for c in self.clauses(text, every=True) for o in c[4] if o[0] in (I, "H")]
            if said:  # marks of all that is said, so that what else the document says has no part in its label
                for m in set.intersection(*({*o[1:], *(["H"] if o[0] == "H" else [])} or {""} for o in said)):
                    found[m][y] += 1
        odds = {m: np.log((b + 0.5) / (a + 0.5)) for m, (a, b) in found.items()}
        self.marks = {m: float((sum(found[m]) * (odds[m] - odds[""]) + TRUST * w) / (sum(found[m]) + TRUST)) for m, w in MARKS.items()}
        self.__dict__.pop("_classes", None)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_classes", "_find", "_machine")}

    def _ready(self) -> None:
        if hasattr(self, "_classes"):
            return
        import ahocorasick

        kinds = ((BREAKS, B), (TARGETS, T), (NEGATIONS, N), (REPORTS, R))
        self._classes = {w: [(c, 0.0)] for words, c in kinds for w in words} | {w: [(V, 0.0), (O, 0.0)] for w in THREATS} | {w: [(I, x), (O, 0.0)] for w, x in self.words.items()}
        self._machine = grammar(self.marks)
        self._find = ahocorasick.Automaton()
        for w in {*self.words, *THREATS, *self.stems}:
            self._find.add_word(w, len(w))
        self._find.make_automaton()

    def read(self, word: str) -> list[tuple[str, float]]:
        """The (class, weight) readings of a lower-case word; apostrophes don't count."""
        word = word.replace("'", "").replace("\u2019", "")
        found = self._classes.get(word)
        if not found:
            stem = max((self.stems[word[:k]] for k in (4, 5, 6, 7) if word[:k] in self.stems), default=None)
            found = [(O, 0.0)] if stem is None else [(I, stem), (O, 0.0)]
        return found

    def clauses(self, text: str, every: bool = False) -> list[tuple[int, int, float, bool, tuple[str, ...]]]:
        """(start, end, weight, whether a threat hits, path) of the matched clauses of the lower-cased text.

        every: insults and threats are read as such whatever that weighs.
        """
        self._ready()
        low, out, until = text.lower(), [], -1
        for end, n in self._find.iter(low):
            a, b = end - n + 1, end + 1
            if a < until or (a and low[a - 1].isalpha()) or (b < len(low) and low[b].isalpha() and low[a:b] not in self.stems):
                continue
            begin = max(low.rfind(c, 0, a) for c in ".!?;:,\n") + 1
            stop = CLAUSE.search(low, b)
            until = stop.start() if stop else len(low)
            words = [self.read(w) for w in WORD.findall(low, begin, until)]
            weight, path = self._machine.best([w[:1] for w in words] if every else words)
            out.append((begin, until, weight, any(y[0] == "H" and "-" not in y for y in path), path))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 6))
        for i, t in enumerate(texts):
            c = [x for x in self.clauses(t) if x[2] > 0]
            if not c:
                continue
            w = [x[2] for x in c]
            total = sum(w)
            out[i] = [1.0, np.log1p(total), max(w), np.log1p(len(c)), any(x[3] for x in c), np.log1p(1000 * total / (len(t) + 200))]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        if self.curve is None:
            return 1 - (1 - self.prior) * np.exp(-x[:, 2])
        return self.curve.score(x)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    return ToxicityModel().learn(common.labelled_sample(docs, labels, "toxic", max_rows))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (common.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
