"""Toxicity by a weighted finite-state pattern grammar.

Words go through a lexical transducer to classes - insult, threat, target,
negation, report, quote, other - with a weight for insults and threats.  Four small
machines read the classes of a clause: one passes on insults and threats, and three note
whether a target, a negation in scope, or reported speech stands with them.
Their composition (the reachable part of their product) is one machine whose
output at each insult or threat is the pattern it was matched in; a clause's score is the
sum of the lexical weights, each times the weight of its pattern.  A
document's score is the logistic of its clauses' scores, pattern by pattern, set against its length in words.

Weights are learned from labelled documents outside the held-out fold: insults
are words and word beginnings that are far likelier in toxic
documents (log odds; counted in Spark), pattern weights a ridge logistic
regression on pattern totals.  Both use at most ``TRAIN_ROWS`` labelled rows,
those with the smallest hashes of their ids, and the lexicon at most ``LEXICON``
entries.  Scoring reads every text whole; clauses without a lexicon word score 0 and are
not run.

Defined results: null and empty texts have no clauses and get the score of a text
without matches; null labels, and labels without a document, are not learned from; of repeated labels
each counts; repeated rows are scored alike; without labelled rows the seed
lexicon and default pattern weights are used; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

HELD_OUT = 2                  # documents whose crc32(id) mod FOLDS is this are held out
FOLDS = 4
CUTOFF = 0.3
TRAIN_ROWS = 12_000
LEXICON = 4_000
BEGINNINGS = (4, 5, 6, 7)
#: A learned entry is at least this many times likelier in toxic training documents than elsewhere, and chance would
#: make it so with a probability of about e^-EVIDENCE (binomial, Chernoff's bound).
LEAST_LIFT, EVIDENCE = 8.0, 15.0
SCOPE = 3                     # words a negation reaches over

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(7)
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown fool dumb ugly filth vermin "
            "idiota estúpido basura imbécile idiote ordure abruti dummkopf trottel abschaum",
    THREAT: "kill killing murder hurt destroy burn stab shoot beat strangle matar töten tuer",
    TARGET: "you your yours yourself u ur they them those these tu tú te usted ustedes vous toi du dich ihr euch",
    NEGATION: "not no never neither nor cannot isn aren wasn don doesn didn won nunca jamás ne pas jamais nicht kein keine nie",
    REPORT: "said says say saying told tells called calls wrote writes quoted reported claims claimed according "
            "dijo dice según dit selon sagte sagt laut",
}
CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)|\n")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer over word classes: arcs[state, class] = (next state, output)."""

    arcs: dict
    start: int = 0


def events() -> Machine:
    """Passes insults and threats on: output 1 for an insult, 2 for a threat, else 0."""
    return Machine({(0, c): (0, {INSULT: 1, THREAT: 2}.get(c, 0)) for c in range(7)})


def noted(mark: int, scope: int | None = None) -> Machine:
    """Output 1 while ``mark`` stands earlier in the clause, at most ``scope`` words before."""
    last = scope or 1
    arcs = {}
    for s in range(last + 1):
        for c in range(7):
            nxt = last if c == mark else max(s - 1, 0) if scope and c != QUOTE else s
            arcs[s, c] = (nxt, int(s > 0))
    return Machine(arcs)


def reported() -> Machine:
    """Output 1 after a word of saying, and between quotation marks."""
    arcs = {}
    for s in range(4):                                   # bit 0: said, bit 1: inside quotation marks
        for c in range(7):
            nxt = s | 1 if c == REPORT else s ^ 2 if c == QUOTE else s
            arcs[s, c] = (nxt, int(s > 0))
    return Machine(arcs)


def compose(machines: list[Machine]) -> Machine:
    """The reachable product: reads classes, outputs the tuple of the machines' outputs."""
    names = {tuple(m.start for m in machines): 0}
    todo, arcs = list(names), {}
    while todo:
        state = todo.pop()
        for c in range(7):
            steps = [m.arcs[s, c] for m, s in zip(machines, state, strict=True)]
            nxt = tuple(s for s, _ in steps)
            if nxt not in names:
                names[nxt] = len(names)
                todo.append(nxt)
            arcs[names[state], c] = (names[nxt], tuple(o for _, o in steps))
    return Machine(arcs)


GRAMMAR = compose([events(), noted(TARGET), noted(NEGATION, SCOPE), reported()])
PATTERNS = 16                 # insult or threat, with or without target, negation, report


def pattern(output: tuple) -> int:
    event, target, negated, said = output
    return (event - 1) * 8 + target * 4 + negated * 2 + said


@dataclass(frozen=True)
class Model:
    """words and beginnings: weight of learned insults; bias, weight per pattern, and weight of the length."""

    words: dict
    beginnings: dict
    bias: float
    patterns: tuple
    length: float

    def lookup(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word)
        if weight is None:
            for n in reversed(BEGINNINGS):
                if len(word) > n and (weight := self.beginnings.get(word[:n])) is not None:
                    break
        if weight is not None:
            return INSULT, weight
        kind = SEEDED.get(word, OTHER)
        return kind, 1.0 if kind in (INSULT, THREAT) else 0.0


SEEDED = {w: kind for kind, words in SEEDS.items() for w in words.split()}
#: Used without labelled rows: insults and threats count, more at a target, less when negated or reported.
DEFAULT = Model({}, {}, -3.0, tuple(2.0 * (1.3 if p & 4 else 1.0) * (0.4 if p & 2 else 1.0) * (0.5 if p & 1 else 1.0) for p in range(PATTERNS)), 0.0)


def clause_patterns(clause: str, model: Model, known: dict) -> list[tuple[int, float]]:
    """(pattern, lexical weight) of each insult or threat of one lower-case clause."""
    out, state, arcs = [], GRAMMAR.start, GRAMMAR.arcs
    for word in TOKEN.findall(clause):
        kind, weight = known.get(word) or (model.lookup(word) if word[0].isalpha() else (QUOTE, 0.0))
        state, output = arcs[state, kind]
        if output[0]:
            out.append((pattern(output), weight))
    return out


def totals(text: str, model: Model) -> np.ndarray:
    """Per pattern, the sum of the lexical weights matched in a whole text; last the number of its words."""
    found = np.zeros(PATTERNS + 1)
    text = text.lower()
    known = {}
    words = WORD.findall(text)
    found[-1] = len(words)
    for word in set(words):
        kind = model.lookup(word)
        if kind[0] in (INSULT, THREAT):
            known[word] = kind
    if known:
        for clause in CLAUSE.split(text):
            if any(map(clause.__contains__, known)):
                for p, weight in clause_patterns(clause, model, known):
                    found[p] += weight
    return found


def score(found: np.ndarray, model: Model) -> float:
    x = np.log1p(found)
    z = model.bias + float(x[:-1] @ np.array(model.patterns)) + model.length * x[-1] * bool(found[:-1].any())
    return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and pattern weights from labelled documents outside the held-out fold."""
    prepare(docs.sparkSession)
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
              .select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
              .orderBy("h", "l_id").limit(train_rows))
    rows = materialise(docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text")).where("text IS NOT NULL")
                       .join(chosen, F.col("doc_id") == F.col("l_id")).select("toxic", "text"), "toxicity-training")
    size = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = size["t"] or 0, size["n"] - (size["t"] or 0)
    if not toxic or not clean:
        return DEFAULT
    words = rows.select("toxic", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("ws"))
    cuts = [F.expr(f"transform(filter(ws, w -> length(w) > {n}), w -> concat(substring(w, 1, {n}), '*'))") for n in BEGINNINGS]
    entry = words.select("toxic", F.explode(F.array_distinct(F.concat("ws", *cuts))).alias("entry"))
    by = entry.groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t >= 4")
    share, n, t = toxic / (toxic + clean), F.col("n"), F.col("t")
    evidence = t * F.log(t / (n * share)) + F.when(n > t, (n - t) * F.log((n - t) / (n * (1 - share)))).otherwise(0)
    lift = ((F.col("t") + 0.5) / toxic) / ((F.col("n") - F.col("t") + 0.5) / clean)
    top = (by.select("entry", "t", lift.alias("lift"), evidence.alias("evidence"))
           .where((F.col("lift") >= LEAST_LIFT) & (F.col("evidence") >= EVIDENCE))
           .orderBy(F.desc("t"), "entry").limit(LEXICON).collect())
    learned = {r["entry"]: float(np.log(r["lift"])) for r in top}
    model = Model({w: v for w, v in learned.items() if w[-1] != "*"}, {w[:-1]: v for w, v in learned.items() if w[-1] == "*"},
                  DEFAULT.bias, DEFAULT.patterns, DEFAULT.length)

    def run(batches):
        for b in batches:
            found = [totals(t, model).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "found"])

    sample = rows.select("toxic", "text").mapInArrow(run, "toxic int, found array<double>").collect()      # train_rows at most
    x = np.log1p(np.array([r["found"] for r in sample]).reshape(-1, PATTERNS + 1))
    x[:, -1] *= x[:, :-1].any(axis=1)                     # the length counts where something was matched
    bias, weights = _regress(x, np.array([r["toxic"] for r in sample], float))
    return Model(model.words, model.beginnings, bias, tuple(weights[:-1]), weights[-1])


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, list[float]]:
    """Ridge logistic regression by Newton's method; only the last weight may fall below 0."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w[1:-1] = np.maximum(w[1:-1], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:].tolist()


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``CUTOFF``) for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    model = model or train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            scores = pa.array([score(totals(t or "", model), model) for t in b.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), scores], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
