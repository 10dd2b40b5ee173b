"""Toxicity: a weighted finite-state pattern grammar over clauses.

A clause's tokens become classes: insult (with a weight learned from labels), threat, target, negation, reported speech,
unclassed word, in English, German, French and Spanish. Four small weighted transducers read them, one after the other:

- negation rewrites insults, threats and words in its scope as negated ones and lowers their weight;
- target raises the insults of a clause that names one, wherever it stands (one branch reads clauses without a target, one
  accepts only those with one);
- threat holds a threat until a target follows within reach, which adds its weight; without one it weighs nothing;
- report lowers all weights of a clause with reported speech (again a branch for either).

`compose` builds their composition, one machine whose arcs carry (scale, add): a token of weight w weighs scale * w + add.
A clause scores the best accepting path's summed weight (the tropical semiring, with weights in place of costs).

Unclassed words are pooled by stem: a prefix that labels show to be toxic when a text has one, two or three words with
it, in whatever form and clause; each counts for the scale of its arc on the clause's best path. A text's score is a
logistic function of its clauses' and stems' summed weight, fitted on the labelled rows.

The whole text is scanned for the trigger words and stems; only clauses that hold one are parsed. Weights are not cut off.
What is learned comes from a sample of about `train_docs` labelled texts, which bounds the words and stems that can reach
the least rate, so all of those are kept.

Defined cases: a null or empty text, or one without a matched clause, scores the fitted base rate, below 0.5; a text of
any length is read whole; repeated rows score alike, and in training equal texts count once; an empty table gives no
rows; without labels the grammar's prior weights hold. A document labelled twice is toxic if either label says so.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, prepare, settle, strings

# The words of the grammar's transducers.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic worthless disgusting dumb fool fools jerk jerks creep vermin imbecile halfwit dimwit scumbag coward cowards ugly bastard bastards retard filth garbage".split()
THREATS = "kill hurt destroy murder stab shoot beat strangle crush punch burn hang".split()
TARGETS = """you your you're youre u yourself he she they them him her his their
    du dich dir dein deine ihr euch euer sie tu toi vous votre vos ils elle elles tú usted ustedes vosotros ellos ellas""".split()
NEGATIONS = """not no never isn't aren't don't doesn't wasn't weren't cannot can't won't without neither nor
    nicht kein keine keinen keinem keiner nie niemals weder ohne ne pas jamais aucun aucune ni sans n'est n'es nunca jamás tampoco ningún ninguna""".split()
REPORTS = """said says say called calls wrote writes claimed claims reported reports quoted quote allegedly according
    sagt sagte nennt nannte schreibt schrieb behauptet behauptete angeblich dit disait appelle écrit prétend selon dice dijo llama llamó escribió afirma según""".split()

CLAUSE_END = re.compile(r"[.!?;\n]+")
TOKEN = re.compile(r"\w+(?:['’]\w+)?")


@dataclass(frozen=True)
class Params:
    train_docs: int = 12000  # at most about so many labelled texts are fitted on
    pull: float = 10.0  # texts' worth of prior for a word's toxic rate
    least_rate: float = 0.7  # a learned word's pulled toxic rate, at least
    prior_weight: float = 2.0  # of a grammar's insult that labels say nothing about
    negated: float = 0.15  # part of a weight that is left
    reported: float = 0.3
    target_gain: float = 1.5
    threat_gain: float = 1.0  # a threat's weight, as a part of the middle weight of the insults that labels know
    reach: int = 6  # tokens between a negation or threat and what it governs
    repeats: int = 3  # words of one stem in a text that are told apart
    stem_chars: tuple[int, int] = (4, 10)  # of a stem, at least and at most


@dataclass
class Model:
    weights: dict[str, float]  # of insults
    slope: float = 1.0
    bias: float = -1.0
    stems: dict[str, list[float]] = field(default_factory=dict)  # weights of one, two, ... words of a stem in a text
    threat: float = 2.0  # weight of a threat
    pattern: re.Pattern = field(init=False)

    def __post_init__(self):
        words = sorted({*self.weights, *THREATS}, key=lambda w: (-len(w), w))
        stems = "|".join(map(re.escape, sorted(self.stems, key=lambda w: (-len(w), w))))
        self.pattern = re.compile(r"\b(?:(?:" + "|".join(map(re.escape, words)) + r")\b" + (f"|(?:{stems})" if stems else "") + ")")
        self.stem = re.compile(stems) if stems else None
        self.classes = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS} | {w: THREAT for w in THREATS} | {w: INSULT for w in self.weights}
        self._machine: tuple[Params, Machine] | None = None

    def machine(self, p: Params) -> Machine:
        """The composed grammar for these parameters, built once."""
        if self._machine is None or self._machine[0] != p:
            self._machine = (p, grammar(p, self.threat))
        return self._machine[1]


@dataclass(frozen=True)
class Machine:
    """A weighted transducer: arcs (input, output, scale, add, next state) by state, and the accepting states."""

    arcs: dict[object, list[tuple[str, str, float, float, object]]]
    start: object
    final: frozenset

    def path(self, classes: list[str], weights: list[float]) -> tuple[float, list[float]]:
        """The best accepting path's weight, and the scale of each token on it; equal paths: the first found."""
        rows: list[dict] = [{self.start: (0.0, None, 1.0)}]
        for c, w in zip(classes, weights):
            row: dict = {}
            for state, (total, _, _) in rows[-1].items():
                for a, _, scale, add, to in self.arcs[state]:
                    if a == c:
                        x = total + scale * w + add
                        if to not in row or x > row[to][0]:
                            row[to] = (x, state, scale)
            rows.append(row)
        ends = [s for s in rows[-1] if s in self.final]
        state = max(ends, key=lambda s: rows[-1][s][0])
        best, scales = rows[-1][state][0], []
        for row in rows[:0:-1]:
            _, before, scale = row[state]
            scales.append(scale)
            state = before
        return best, scales[::-1]


def compose(one: Machine, two: Machine) -> Machine:
    """Reads as `one` and passes its outputs to `two`; of a token that weighs scale * w + add, `two` makes its own."""
    start = (one.start, two.start)
    arcs: dict = {}
    work = [start]
    while work:
        state = work.pop()
        if state in arcs:
            continue
        arcs[state] = [(a, c, s1 * s2, s2 * a1 + a2, (to1, to2)) for a, b, s1, a1, to1 in one.arcs[state[0]] for b2, c, s2, a2, to2 in two.arcs[state[1]] if b == b2]
        work += [x[4] for x in arcs[state]]
    return Machine(arcs, start, frozenset(s for s in arcs if s[0] in one.final and s[1] in two.final))


# The classes of tokens. Lower case: in the scope of a negation.
OTHER, NEGATION, REPORT, TARGET, THREAT, INSULT, WORD = "ONRTKIU"
PLAIN = (OTHER, NEGATION, REPORT, TARGET)
HELD = (THREAT, INSULT, WORD)


def negation(p: Params) -> Machine:
    """State: tokens that the last negation still governs."""
    arcs = {}
    for left in range(p.reach + 1):
        after = max(left - 1, 0)
        arcs[left] = [(c, c, 1.0, 0.0, p.reach if c == NEGATION else after) for c in PLAIN]
        arcs[left] += [(c, c.lower() if left else c, p.negated if left else 1.0, 0.0, after) for c in HELD]
    return Machine(arcs, 0, frozenset(arcs))


def _either(sign: str, scales: dict[str, float]) -> Machine:
    """One branch for clauses without the sign, one for those with it, whose classes are scaled."""
    every = (*PLAIN, *HELD, *[c.lower() for c in HELD])
    arcs = {"begin": [], "without": [(c, c, 1.0, 0.0, "without") for c in every if c != sign]}
    for state in ("before", "after"):
        arcs[state] = [(c, c, scales.get(c, 1.0), 0.0, "after" if c == sign else state) for c in every]
    arcs["begin"] = arcs["without"] + arcs["before"]
    return Machine(arcs, "begin", frozenset({"begin", "without", "after"}))


def target(p: Params) -> Machine:
    return _either(TARGET, {INSULT: p.target_gain, INSULT.lower(): p.target_gain})


def report(p: Params) -> Machine:
    return _either(REPORT, dict.fromkeys((*PLAIN, *HELD, *[c.lower() for c in HELD]), p.reported))


def threat(p: Params, weight: float) -> Machine:
    """State: the threat that is held, negated or not, and the tokens within which a target must follow."""
    states = [(None, 0), *[(k, left) for k in (THREAT, THREAT.lower()) for left in range(1, p.reach + 1)]]
    arcs = {}
    for held, left in states:
        after = (held, left - 1) if left > 1 else (None, 0)
        full = weight * (p.negated if held == THREAT.lower() else 1.0) if held else 0.0
        arcs[held, left] = [(c, c, 1.0, 0.0, after) for c in (OTHER, NEGATION, REPORT, INSULT, WORD, INSULT.lower(), WORD.lower())]
        arcs[held, left] += [(TARGET, TARGET, 1.0, full, (None, 0))]
        arcs[held, left] += [(k, k, 0.0, 0.0, (k, p.reach)) for k in (THREAT, THREAT.lower())]
    return Machine(arcs, (None, 0), frozenset(arcs))


def grammar(p: Params, threat_weight: float) -> Machine:
    return compose(compose(compose(negation(p), target(p)), threat(p, threat_weight)), report(p))


def parse(tokens: list[str], m: Model, p: Params = Params()) -> tuple[float, list[tuple[str, float]]]:
    """A clause's weight, and its unclassed words, each with the part of a word that it counts for."""
    classes, weights = [], []
    for t in tokens:
        c = m.classes.get(t.replace("\u2019", "'"), WORD)
        classes.append(c)
        weights.append(m.weights[t] if c == INSULT else 0.0)
    best, scales = m.machine(p).path(classes, weights)
    return best, [(t, x) for t, c, x in zip(tokens, classes, scales) if c == WORD]


def stem_repeats(text: str, m: Model, p: Params = Params()) -> dict[str, int]:
    """How many words, up to p.repeats, each prefix in a text counts for; prefixes of less than one word are left out."""
    words: dict[str, float] = {}
    for clause in CLAUSE_END.split(text.lower()):
        for t, x in parse(TOKEN.findall(clause), m, p)[1]:
            words[t] = words.get(t, 0.0) + x
    mass: dict[str, float] = {}
    for t, x in words.items():
        for k in range(p.stem_chars[0], min(len(t), p.stem_chars[1]) + 1):
            mass[t[:k]] = mass.get(t[:k], 0.0) + x
    return {s: min(int(x + 1e-9), p.repeats) for s, x in mass.items() if x + 1e-9 >= 1}


def text_weight(text: str, m: Model, p: Params = Params()) -> float:
    """Sum over the clauses that hold a trigger word or stem, and over the stems."""
    low = text.lower()
    total, upto = 0.0, 0
    mass: dict[str, float] = {}
    for hit in m.pattern.finditer(low):
        if hit.start() < upto:
            continue
        begin = max(low.rfind(c, upto, hit.start()) for c in ".!?;\n") + 1
        begin = max(begin, upto)
        end = CLAUSE_END.search(low, hit.end())
        upto = end.end() if end else len(low)
        tokens = TOKEN.findall(low, begin, upto)
        weight, words = parse(tokens, m, p)
        total += weight
        for t, x in words if m.stem else ():
            if at := m.stem.match(t):
                mass[at[0]] = mass.get(at[0], 0.0) + x
    for s, x in mass.items():
        if x + 1e-9 >= 1:
            total += m.stems[s][min(int(x + 1e-9), len(m.stems[s])) - 1]
    return total


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and bias by Newton steps, with a weak pull of the slope to 1; the slope stays positive."""
    a, b = 1.0, -1.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((y - q) * x).sum() - 1.0 * (a - 1), (y - q).sum() - 0.1 * (b + 1)])
        h = np.array([[(w * x * x).sum() + 1.0, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = max(a + float(np.clip(step[0], -1, 1)), 0.05), b + float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    return a, min(b, -0.1)


def train(docs: DataFrame, labels: DataFrame, usable: Column, p: Params = Params()) -> Model:
    """usable: a condition on doc_id. Fits on about p.train_docs labelled texts, chosen by hash of their id."""
    spark = prepare(docs.sparkSession)
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    chosen = known.where(hashed_share(F.col("doc_id"), "toxicity", min(1.0, p.train_docs / max(n, 1)))).limit(2 * p.train_docs)
    # The chosen labels are at most 2 * train_docs rows of two numbers, so they may be broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def words(batches):
        for b in batches:
            out = [sorted(set(TOKEN.findall(t.lower()))) for t in strings(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), b.column(1)], ["words", "toxic"])

    kind = docs.sparkSession.createDataFrame([], labels.select("toxic").schema).schema[0].dataType.simpleString()
    texts = sample.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    texts = settle(texts)
    per = texts.mapInArrow(words, f"words array<string>, toxic {kind}")
    sums = per.select(F.explode("words").alias("w"), "toxic").groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
    base = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    rate = (base["pos"] or 0) / base["n"] if base["n"] else 0.1
    least = p.pull * (p.least_rate - rate) / (1 - p.least_rate + 1e-9)
    found = sums.withColumn("rate", (F.col("pos") + p.pull * rate) / (F.col("n") + p.pull))
    found = found.where(F.col("w").isin(INSULTS) | ((F.col("rate") >= p.least_rate) & (F.col("pos") >= max(least, 3)))).orderBy(F.desc("pos"), "w")
    logit = lambda q: math.log(q / (1 - q))
    prior = max(min(rate, 0.5), 1e-3)
    weights = dict.fromkeys(INSULTS, p.prior_weight)
    for w, k, pos, r in found.select("w", "n", "pos", "rate").collect():
        q = min(max(r, 1e-3), 1 - 1e-3)
        learned = logit(q) - logit(prior)
        weights[w] = (p.pull * p.prior_weight + k * learned) / (p.pull + k) if w in weights else learned
    m = Model({w: x for w, x in weights.items() if x > 0 and w not in TARGETS and w not in NEGATIONS})
    seen = sorted(x for w, x in m.weights.items() if x != p.prior_weight) or [p.prior_weight]
    m.threat = p.threat_gain * seen[len(seen) // 2]
    words_only = spark.sparkContext.broadcast(m.weights)

    def prefixes(batches):
        model = Model(words_only.value)
        for b in batches:
            out = [stem_repeats(t, model, p) for t in strings(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([list(o) for o in out], pa.list_(pa.string())), pa.array([list(o.values()) for o in out], pa.list_(pa.int32())), b.column(1)], ["s", "r", "toxic"])

    per = texts.mapInArrow(prefixes, f"s array<string>, r array<int>, toxic {kind}").select(F.explode(F.arrays_zip("s", "r")).alias("x"), "toxic")
    levels = range(1, p.repeats + 1)
    counts = per.groupBy("x.s").agg(*[f(F.when(F.col("x.r") >= r, y)).alias(f"{a}{r}") for r in levels for a, f, y in (("n", F.count, F.lit(1)), ("pos", F.sum, F.col("toxic")))])
    toxic = F.lit(False)
    for r in levels:
        toxic = toxic | ((F.col(f"pos{r}") >= max(least, 3)) & ((F.col(f"pos{r}") + p.pull * rate) / (F.col(f"n{r}") + p.pull) >= p.least_rate))
    arcs = []
    for x in counts.where(toxic).orderBy(F.desc("pos1"), "s").collect():
        at, best = [0.0] * p.repeats, (0, 0.0)
        for r in levels:
            pos, n = x[f"pos{r}"] or 0, x[f"n{r}"]
            q = (pos + p.pull * rate) / (n + p.pull)
            if pos >= max(least, 3) and q >= p.least_rate:
                at[r - 1], best = logit(min(q, 1 - 1e-3)) - logit(prior), max(best, (pos, q))
            if r > 1:  # more words never weigh less
                at[r - 1] = max(at[r - 1], at[r - 2])
        arcs.append((best, x["s"], at))
    # Of prefixes of one another, the one with the most toxic texts stays, then the surer, then the longer.
    for _, s, at in sorted(arcs, key=lambda x: (x[0], len(x[1]), x[1]), reverse=True):
        if not any(s.startswith(k) or k.startswith(s) for k in m.stems):
            m.stems[s] = at
    m = Model(m.weights, stems=m.stems, threat=m.threat)
    shared = spark.sparkContext.broadcast((m.weights, 1.0, -1.0, m.stems, m.threat))

    def weigh(batches):
        model = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_weight(t, model, p) for t in strings(b, "text")]), b.column(1).cast(pa.float64())], ["x", "y"])

    got = texts.mapInArrow(weigh, "x double, y double").toArrow()
    if got.num_rows:
        m.slope, m.bias = _fit(got["x"].to_numpy(), np.clip(got["y"].to_numpy(), 0, 1))
    return m


def score(docs: DataFrame, m: Model, keep: list[str], p: Params = Params()) -> DataFrame:
    """The columns `keep` with score and predicted. Only `text` is an input of the score."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast((m.weights, m.slope, m.bias, m.stems, m.threat))
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))

    def run(batches):
        model = Model(*shared.value)
        for b in batches:
            x = np.array([text_weight(t, model, p) for t in strings(b, "t")], float)
            s = 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*[f"k{i}" for i in range(len(keep))], "score", "predicted"])

    fields = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return inner.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"])).toDF(*keep, "score", "predicted")
