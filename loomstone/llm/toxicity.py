"""Toxicity by a weighted finite-state pattern grammar.

A document is cut into clauses. Words of a clause become symbols (insult, threat, target, negation, report, other);
a cascade of weighted transducers reads them: negation weakens what it governs, reported speech weakens
what is quoted, and the pattern transducer weighs insults and threats, more where a target stands by. Only clauses
with an insult or a threat are read. Weights of words, words beyond the fixed lists, and the step from weight to
probability are learned from labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, remainder

# Word lists of the grammar, fixed values.
INSULTS = "idiot idiots moron morons loser losers stupid scum trash clown clowns worthless pathetic disgusting dumb fool fools imbecile jerk ugly garbage vermin coward liar creep filth pig freak brainless useless ignorant hateful dummkopf trottel arschloch idiota imbécil estúpido estúpida basura connard crétin débile".split()
THREATS = "kill hurt destroy beat shoot stab strangle burn punish crush töten matar tuer".split()
TARGETS = "you your yours yourself u ur they them their he she him her people everyone du dich dein ihr euch tu te toi vous usted ustedes tú vosotros".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't can't cannot without hardly nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say saying called calls quoted quote quotes wrote writes claimed reported according allegedly sagte schrieb dit dijo".split()

#: Different labelled texts that the weights are fitted on, at most; taken by the least hash.
FIT_ROWS = 20_000
#: A word joins the insults if so many labelled toxic documents have it, in contexts that mostly differ, and so much likelier than clean ones.
LEARN_DOCS, LEARN_CONTEXTS, LEARN_ODDS = 12, 0.6, 3.5
THRESHOLD = 0.7
#: Weights of documents beyond this are alike to the curve.
ENOUGH = 4.0
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”«»]")
ENDS = re.compile(r"[.!?;:\n]")


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol out, weight); what has no arc passes through, state kept."""

    arcs: dict[tuple[str, str], tuple[str, str, float]]
    start: str = "0"

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "*")) or (state, symbol, 0.0)

    def then(self, other: Transducer) -> Composed:
        return Composed(self, other)


@dataclass
class Composed:
    """Two transducers, the second reading what the first writes; weights add."""

    first: Transducer | Composed
    second: Transducer
    start: tuple = field(init=False)

    def __post_init__(self) -> None:
        self.start = (self.first.start, self.second.start)

    def then(self, other: Transducer) -> Composed:
        return Composed(self, other)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        a, middle, x = self.first.step(state[0], symbol)
        b, out, y = self.second.step(state[1], middle)
        return (a, b), out, x + y


def negation(reach: int = 3) -> Transducer:
    """An insult or threat within `reach` words after a negation comes out in lower case."""
    arcs = {("0", "N"): (f"n{reach}", "N", 0.0)}
    for k in range(reach, 0, -1):
        below = f"n{k - 1}" if k > 1 else "0"
        arcs |= {(f"n{k}", "I"): ("0", "i", 0.0), (f"n{k}", "T"): ("0", "t", 0.0), (f"n{k}", "N"): (f"n{reach}", "N", 0.0)}
        arcs |= {(f"n{k}", s): (below, s, 0.0) for s in "OPRQ"}
    return Transducer(arcs)


def reported() -> Transducer:
    """After a reporting verb and a quotation mark, what is quoted comes out in lower case until the mark that ends it."""
    arcs = {("0", "R"): ("r", "R", 0.0), ("r", "Q"): ("q", "Q", 0.0), ("q", "Q"): ("0", "Q", 0.0)}
    arcs |= {("q", "I"): ("q", "i", 0.0), ("q", "T"): ("q", "t", 0.0)}
    return Transducer(arcs)


def patterns(insult: float = 1.0, threat: float = 1.0, aimed: float = 0.5, weak: float = 0.2) -> Transducer:
    """Insults weigh by themselves, more with a target in the clause; threats only count before or after a target."""
    arcs = {}
    for state, bonus in (("0", 0.0), ("p", aimed)):
        arcs |= {(state, "I"): (state, "I", insult + bonus), (state, "i"): (state, "i", weak * insult), (state, "P"): ("p", "P", 0.0)}
    arcs |= {("0", "T"): ("t", "T", 0.0), ("p", "T"): ("p", "T", threat), ("t", "P"): ("p", "P", threat), ("t", "I"): ("t", "I", insult), ("t", "i"): ("t", "i", weak * insult)}
    return Transducer(arcs)


def cascade() -> Composed:
    return negation().then(reported()).then(patterns())


@dataclass
class Model:
    """words: weight of each insult or threat; cut, slope: a document's weight to probability by a logistic curve."""

    words: dict[str, float]
    threats: frozenset[str] = frozenset(THREATS)
    cut: float = -3.0
    slope: float = 6.0

    def prepare(self) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for w in {*self.words, *self.threats}:
            self.find.add_word(w, w)
        self.find.make_automaton()
        self.kinds = {w: "P" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS} | {w: "T" for w in self.threats} | {w: "I" for w in self.words} | dict.fromkeys("\"“”«»", "Q")
        self.grammar = cascade()

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses of the lower-cased text that match, by start."""
        if not hasattr(self, "grammar"):
            self.prepare()
        low, out, done = text.lower(), [], -1
        for end, w in self.find.iter(low):
            start = end - len(w) + 1
            if start < done or (start and (low[start - 1].isalnum() or low[start - 1] == "_")) or (end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_")):
                continue
            a = max(0, done, 1 + max(low.rfind(x, max(done, 0), start) for x in ".!?;:\n"))
            m = ENDS.search(low, end)
            done = m.end() if m else len(low)
            state, weight = self.grammar.start, 0.0
            for x in WORD.finditer(low, a, done):
                state, _, plus = self.grammar.step(state, self.kinds.get(x[0], "O"))
                weight += plus * (self.words.get(x[0], 1.0) if plus else 1.0)
            out.append((a, done, weight))
        return out

    def weight(self, text: str | None) -> float:
        return sum(w for _, _, w in self.clauses(text or ""))

    def probability(self, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.cut + self.slope * np.minimum(weight, ENOUGH), -30, 30)))


def word_statistics(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean, contexts): documents with the word by label; the different pairs of neighbours in toxic ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        clean: Counter = Counter()
        rows = []
        shown = lambda: pd.DataFrame(rows, columns=["word", "toxic", "clean", "context"]).astype({"context": "Int64"})
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = WORD.findall(text.lower())
                if toxic:
                    first = {w: k for k, w in reversed([*enumerate(words)])}
                    rows += [(w, 1, 0, xxhash.xxh32_intdigest(" ".join(words[max(k - 1, 0) : k] + ["_"] + words[k + 1 : k + 2]))) for w, k in first.items() if w.isalpha()]
                else:
                    clean.update({w for w in words if w.isalpha()})
                if len(rows) > 20_000:
                    yield shown()
                    rows = []
        if rows:
            yield shown()
        if clean:
            yield pd.DataFrame({"word": [*clean], "toxic": 0, "clean": [*clean.values()], "context": pd.array([None] * len(clean), "Int64")})

    each = labelled.mapInPandas(count, "word string, toxic long, clean long, context long")
    return each.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.countDistinct("context").alias("contexts"))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): each different labelled text once, whatever rows have it; `rows` of them at most, those of the least hashes of doc_id
    before texts are told apart. A table in the shared folder, the same however documents are partitioned."""
    train = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(train), "doc_id")
    once = materialize(found.select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", (F.col("toxic") > 0).alias("toxic")))
    if once.count() <= rows:
        return once
    # Only rows that repeat a doc_id with other texts lead here.
    last = once.select(F.xxhash64("text").alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    out = materialize(once.where(F.xxhash64("text") <= last))
    discard(once)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from documents with a label whose crc32(doc_id as text) mod 3 is not 1, at most `rows` different texts of them.

    Without such rows the fixed lists and weights hold. A doc_id or text with several labels counts as toxic if one says so.
    """
    labelled = training_texts(docs, labels, rows)
    totals = {bool(r["toxic"]): r["count"] for r in labelled.groupBy("toxic").count().collect()}
    words = dict.fromkeys(INSULTS, 1.0)
    if len(totals) < 2:
        return Model(words)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(totals[True] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(totals[False] + 1.0))
    table = word_statistics(labelled).where("toxic > 0").withColumn("odds", odds)
    known = F.col("word").isin(INSULTS) & (F.col("toxic") + F.col("clean") >= 5)
    learned = (F.col("toxic") >= LEARN_DOCS) & (F.col("contexts") >= LEARN_CONTEXTS * F.col("toxic")) & (F.col("odds") >= LEARN_ODDS) & (F.length("word") > 2)
    for r in table.where(known | learned).select("word", "odds").collect():
        words[r["word"]] = float(np.clip(r["odds"] / 3.0, 0.0, 1.5))
    for w in (*TARGETS, *NEGATIONS, *REPORTS):
        words.pop(w, None)
    model = Model(words, frozenset(w for w in THREATS if w not in words))
    found = weights(labelled, model).toPandas()
    model.cut, model.slope = logistic(found["weight"].to_numpy(float), found["toxic"].to_numpy(float))
    discard(labelled)
    return model


def weights(labelled: DataFrame, model: Model) -> DataFrame:
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"weight": [model.weight(t) for t in batch["text"]], "toxic": batch["toxic"].astype(float)})

    return labelled.mapInPandas(weigh, "weight double, toxic double")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's steps on cut and slope, with a weak prior so that a clean split stays finite."""
    x = np.minimum(x, ENOUGH)
    b = np.array([-3.0, 3.0])
    data = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ b, -30, 30)))
        grad = data.T @ (y - p) - 0.02 * (b - [-3.0, 6.0])
        hess = (data * (p * (1 - p))[:, None]).T @ data + 0.02 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        b = b + np.clip(move, -2, 2)
        if abs(move).max() < 1e-6:
            break
    return float(b[0]), float(max(b[1], 0.5))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses for every row of docs; clauses: (start, end, weight) of those that matched.

    Null and empty texts have the score of no match. Repeated rows are scored alike. A null doc_id is not held out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.clauses(t) if isinstance(t, str) and t else [] for t in batch["text"]]
            p = model.probability(np.array([sum(w for _, _, w in x) for x in found], float))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": (p >= THRESHOLD).astype(np.int32), "clauses": [[{"start": a, "end": b, "weight": w} for a, b, w in x] for x in found]})

    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, clauses array<struct<start: int, end: int, weight: double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all columns."""
    schema = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = schema.fieldNames().index("text")
        for batch in batches:
            w = np.array([model.weight(t.as_py()) for t in batch.column(at)], float)
            yield batch.filter(pa.array(model.probability(w) < THRESHOLD))

    return docs.mapInArrow(run, schema)
