"""Mixing sources to target weights by soft domain membership, in DataFrame functions only.

Domains come from the labelled table: ``toxic`` (toxic = 1), ``low`` (quality 0)
and ``clean``.  A classifier made of Spark aggregates gives every document a
posterior per domain: Gaussian naive Bayes over four statistics of the text, and for toxic the
log-odds of how often each word of a learned list of telling words occurs among the words
of the text (Poisson, with the words' rates in toxic and in other documents): a mention in a
long text speaks against toxic, the same word in a short one for it.

Every document i has a rate r_i >= 0.  With n_i tokens and posteriors p_ik the
expected tokens of domain k are T_k = sum_i r_i n_i p_ik.  Projected-gradient least
squares brings T to the targets: from r_i = 1, each round computes the residual
T - t (one aggregate of K sums), turns it into a step d = M^-1 (T - t) and sets
r_i = max(0, r_i - p_i d).  M = sum n_i p_i p_i' is taken once over all documents;
it whitens the least squares, so that the gradient's Lipschitz constant is 1 and
every round of step length 1 brings T nearer.  A document's rate after any number
of rounds is a fold over the short list of steps, so no round writes a table and
only K numbers reach the driver.

Targets are shares; the budget defaults to ``BOOST`` times what lets ``clean`` keep all its
expected tokens.  A document whose posterior mistakes it for another domain can still fall below rate 1 (see README).

Defined results: null and empty texts have no tokens and rate 1; null labels and
labels without a document are ignored, of repeated labels each counts; without labelled rows every document
is ``clean``; a domain without any expected tokens gets no target; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching, materialise, prepare

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
BOOST = 1.1
ROUNDS = 40
TOLERANCE = 1e-5
#: Bounds of the fitted classifier: labelled documents used for it, and telling words kept.
TRAIN_ROWS = 20_000
TELLING = 200
#: A telling word occurs in this many toxic training documents and this many times likelier there than elsewhere.
LEAST_DOCS, LEAST_LIFT = 5, 30.0
STATS = ("x0", "x1", "x2", "x3")
EVIDENCE = "x4"
FLOOR = 1e-3               # least variance of a statistic
#: Variance of the mean word length of a text of one word, as a share of its square: short texts say little by it.
SPREAD = 0.2


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)


def telling_words(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, size: int = TELLING) -> dict[str, tuple[float, float]]:
    """The words most typical of documents labelled toxic, from the ``train_rows`` labelled rows with the smallest id hashes,
    with their rates among the words of toxic and of other documents."""
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), "toxic")
              .orderBy("h", "doc_id").limit(train_rows)
              .select(F.col("doc_id").alias("l_id"), "toxic"))
    rows = (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
            .join(F.broadcast(chosen), F.col("id") == F.col("l_id")))                # train_rows pairs at most: no text is shuffled
    split = materialise(rows.select("toxic", _words(F.col("text")).alias("words")), "mixing-training")
    words = (split.select(F.monotonically_increasing_id().alias("row"), "toxic", F.explode("words").alias("w")).where("length(w) > 2")
             .groupBy("row", "toxic", "w").agg(F.count("*").alias("times")))
    by = words.groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"),
                                F.sum(F.col("toxic") * F.col("times")).alias("t_times"), F.sum("times").alias("n_times"))
    all_ = split.agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), F.sum(F.col("toxic") * F.size("words")).alias("t_words"),
                     F.sum(F.size("words")).alias("n_words")).first()
    if not all_["t"] or all_["t"] == all_["n"]:
        return {}
    lift = ((F.col("t") + 0.5) / all_["t"]) / ((F.col("n") - F.col("t") + 0.5) / (all_["n"] - all_["t"]))
    found = (by.where(f"t >= {LEAST_DOCS}").select("w", "t", lift.alias("lift"), "t_times", "n_times")
             .where(F.col("lift") >= LEAST_LIFT).orderBy(F.desc("t"), "w").limit(size).collect())
    return {r["w"]: ((r["t_times"] + 0.5) / all_["t_words"], (r["n_times"] - r["t_times"] + 0.5) / (all_["n_words"] - all_["t_words"])) for r in found}


def _evidence(words: Column, telling: dict[str, tuple[float, float]]) -> Column:
    """Log-odds of toxic against the rest, by how often the telling words occur among ``words``."""
    if not telling:
        return F.lit(0.0)
    weight = F.create_map(*(F.lit(x) for w, (t, r) in telling.items() for x in (w, math.log(t / r))))
    found = F.array_intersect(words, F.array(*map(F.lit, telling)))
    seen = F.aggregate(found, F.lit(0.0), lambda sum_, w: sum_ + F.element_at(weight, w) * F.size(F.filter(words, lambda v: v == w)))
    return seen - F.size(words) * sum(t - r for t, r in telling.values())


def statistics(docs: DataFrame, telling: dict[str, tuple[float, float]]) -> DataFrame:
    """id, th, n (tokens: words), x0..x3 and the evidence x4 of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), text.alias("text"), _words(text).alias("words"))
    n = F.size(F.split(F.trim("text"), r"\s+", -1)) - F.when(F.trim("text") == "", 1).otherwise(0)
    chars = F.length("text")
    words = F.col("words")
    return rows.select(
        "id", "th", n.cast("bigint").alias("n"),
        F.log1p(chars).alias("x0"), F.log1p(chars / F.greatest(n, F.lit(1))).alias("x1"),
        F.sqrt(F.regexp_count("text", F.lit("[#*$%&|<>]")) / F.greatest(chars, F.lit(1))).alias("x2"),
        (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("x3"),
        _evidence(words, telling).alias(EVIDENCE))


def classifier(stats: DataFrame, labels: DataFrame) -> list[dict]:
    """Per domain that has labelled rows: name, prior, and mean and variance of each statistic (at most three rows)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    own = labels.select(F.col("doc_id").alias("l_id"), domain.alias("domain")).where("domain IS NOT NULL AND l_id IS NOT NULL")
    rows = stats.join(own, F.col("id") == F.col("l_id"))
    got = rows.groupBy("domain").agg(F.count("*").alias("rows"), *(F.avg(x).alias(f"m_{x}") for x in STATS),
                                     *(F.var_pop(x).alias(f"v_{x}") for x in STATS)).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: DOMAINS.index(r["domain"]))]


def posteriors(stats: DataFrame, model: list[dict]) -> DataFrame:
    """``stats`` with p_clean, p_low, p_toxic, which sum to 1."""
    logs = {}
    for m in model:
        spread = {x: F.lit(m[f"v_{x}"] + FLOOR) for x in STATS}
        spread["x1"] += SPREAD / F.greatest("n", F.lit(1))
        terms = [F.pow(F.col(x) - m[f"m_{x}"], 2) / (-2.0 * spread[x]) - 0.5 * F.log(spread[x]) for x in STATS]
        if m["domain"] == "toxic":
            terms.append(F.col(EVIDENCE))
        logs[m["domain"]] = reduce(lambda a, b: a + b, terms, F.log(F.lit(float(m["rows"]))))
    if not logs:
        return stats.select("*", *(F.lit(float(d == "clean")).alias(f"p_{d}") for d in DOMAINS))
    named = stats.select("*", *(v.alias(f"log_{d}") for d, v in logs.items()))
    top = F.greatest(*(f"log_{d}" for d in logs)) if len(logs) > 1 else F.col(f"log_{next(iter(logs))}")
    raw = named.select("*", *(F.exp(F.col(f"log_{d}") - top).alias(f"e_{d}") for d in logs))
    total = reduce(lambda a, b: a + b, (F.col(f"e_{d}") for d in logs))
    return raw.select(*stats.columns, *(((F.col(f"e_{d}") / total) if d in logs else F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small symmetric system; directions without weight get 0."""
    k = len(right)
    rows = [list(matrix[i]) + [right[i]] for i in range(k)]
    scale = max((abs(matrix[i][i]) for i in range(k)), default=0.0) or 1.0
    free = []
    for i in range(k):
        pivot = max(range(i, k), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        if abs(rows[i][i]) < 1e-12 * scale:
            free.append(i)
            continue
        for r in range(k):
            if r != i:
                f = rows[r][i] / rows[i][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [0.0 if i in free else rows[i][k] / rows[i][i] for i in range(k)]


def _rate(steps: list[list[float]]) -> Column:
    p = [f"p_{d}" for d in DOMAINS]
    if not steps:
        return F.lit(1.0)
    listed = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    return F.aggregate(listed, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (F.col(c) * s[k] for k, c in enumerate(p)))))


def fit_rates(rows: DataFrame, targets: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Column:
    """The rate, as a column over ``rows`` (n, p_*: a written table), whose expected tokens meet ``targets`` (tokens per domain)."""
    p = [f"p_{d}" for d in DOMAINS]
    goal = [targets[d] for d in DOMAINS]
    size = sum(goal) or 1.0
    k = len(p)
    m = rows.agg(*(F.sum(F.col("n") * F.col(a) * F.col(b)) for a in p for b in p)).first()
    m = [[float(m[i * k + j] or 0.0) for j in range(k)] for i in range(k)]
    ridge = 1e-6 * max(m[i][i] for i in range(k))
    m = [[m[i][j] + ridge * (i == j) for j in range(k)] for i in range(k)]
    steps: list[list[float]] = []
    for _ in range(rounds):
        r = rows.select("n", *p, _rate(steps).alias("r"))
        got = r.agg(*(F.sum(F.col("r") * F.col("n") * F.col(c)) for c in p)).first()
        off = [float(g or 0.0) - t for g, t in zip(got, goal, strict=True)]
        if max(map(abs, off)) <= tolerance * size:
            break
        step = _solve(m, off)
        if not any(step):
            break
        steps.append(step)
    return _rate(steps)


def fit_chances(rows: DataFrame, shares: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Column:
    """The chance to stay, at most 1, as a column over ``rows`` (n, p_*: a written table), under which expected tokens have these shares.

    The first domain that has tokens and a share is the base: its documents are kept (up to ``BOOST`` against the other
    domains' steps), and the others' targets follow its tokens.  A domain with fewer tokens than its share keeps them all.
    """
    p = [f"p_{d}" for d in DOMAINS]
    got = rows.agg(*(F.sum(F.col("n") * F.col(a) * F.col(b)) for a in p for b in p), *(F.sum(F.col("n") * F.col(a)) for a in p)).first()
    got = [float(g or 0.0) for g in got]
    k = len(p)
    base = next((i for i, d in enumerate(DOMAINS) if got[k * k + i] and shares[d]), None)
    if base is None:
        return F.lit(1.0)
    others = [i for i in range(k) if i != base and got[k * k + i]]
    ridge = 1e-6 * max(got[i * k + i] for i in range(k))
    m = [[got[i * k + j] + ridge * (i == j) for j in others] for i in others]
    push = [0.0] * k
    push[base] = 1.0 - BOOST

    def chance() -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - reduce(lambda a, b: a + b, (F.col(c) * x for c, x in zip(p, push, strict=True)))))

    for _ in range(rounds):
        r = rows.select("n", *p, chance().alias("r"))
        there = [float(g or 0.0) for g in r.agg(*(F.sum(F.col("r") * F.col("n") * F.col(c)) for c in p)).first()]
        off = [there[i] - shares[DOMAINS[i]] / shares[DOMAINS[base]] * there[base] for i in others]
        off = [0.0 if x < 0 and not push[i] else x for x, i in zip(off, others, strict=True)]
        if max(map(abs, off), default=0.0) <= tolerance * there[base]:
            break
        for i, x in zip(others, _solve(m, off), strict=True):
            push[i] = max(0.0, push[i] + x)
    return chance()


def _domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, th, n, p_clean, p_low, p_toxic of every row of ``docs``, written."""
    prepare(docs.sparkSession)
    stats = materialise(statistics(docs, telling_words(docs, labels)), "mixing-statistics")
    return materialise(posteriors(stats, classifier(stats, labels)).drop(*STATS, EVIDENCE), "mixing-posteriors")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """id, th, n_tokens, p_clean, p_low, p_toxic, rate for every row of ``docs`` (doc_id, text).

    ``targets`` are shares per domain, ``budget`` the tokens they are shares of.
    """
    shares = targets or TARGETS
    rows = _domains(docs, labels)
    got = rows.agg(*(F.sum(F.col("n") * F.col(f"p_{d}")) for d in DOMAINS)).first()
    there = {d: float(x or 0.0) for d, x in zip(DOMAINS, got, strict=True)}
    if budget is None:
        budget = BOOST * there["clean"] / shares["clean"]
    goal = {d: shares[d] * budget if there[d] else 0.0 for d in DOMAINS}
    return rows.select("id", "th", F.col("n").alias("n_tokens"), *(f"p_{d}" for d in DOMAINS), fit_rates(rows, goal).alias("rate"))


def keep_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` drawn once at most, at chances that bring the kept tokens to the targets (by a hash of the row)."""
    rows = _domains(docs, labels)
    drawn = F.pmod(F.xxhash64("id", "th", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    kept = rows.where(drawn < fit_chances(rows, targets or TARGETS)).select("id", "th").distinct()
    return matching(docs, kept, [docs["doc_id"], F.xxhash64(docs["text"])])
