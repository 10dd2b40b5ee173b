"""PII: base patterns and, over them, a skip-chain conditional random field.

The nodes are a document's tokens with a digit or an @; every other token is fixed as outside. Labels: outside, email,
ip, card, phone. Node potentials are a log-linear model of shape features, chain potentials join neighbouring tokens,
and skip potentials join each token to the next one with the same digits (or the same text), however far away. Loopy
sum-product messages enforce consistent labels over the whole document. Base matches are evidence: their tokens are
held to their kind. Tokens outside of base matches whose belief in a kind is at least `belief` add spans.

All parameters are fitted on a bounded, hashed sample of documents, labelled by the base patterns.

Defined cases: a null or empty text has no spans; texts of any length are read whole, by scans that are linear in their
length; equal texts give equal spans, so repeated rows agree; an empty table gives no rows; ties between labels go to
the first in the order above; extra columns are kept by `mask` and ignored by `digest`. Skip edges join consecutive
occurrences only, so a token repeated n times has n - 1 of them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, prepare, strings

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HIT = re.compile(r"[0-9@]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NOT_DIGIT = re.compile(r"[^0-9]+")
TRIM = ".,;:!?\"'[]{}<>"


@dataclass(frozen=True)
class Params:
    train_docs: int = 6000  # at most about so many texts are fitted on
    rounds: int = 10  # of messages
    damping: float = 0.3
    evidence: float = 8.0  # added to the potential of a base match's label
    belief: float = 0.9


Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, upto = [], 0
    at = text.find("@")
    while at >= 0:
        head = text[upto:at]
        begin = upto + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
        upto = m.end() if m else at + 1
        at = text.find("@", upto)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        pieces, at = [], run.start()
        for piece in [*run.group().split("."), ""]:
            if piece:
                pieces.append((piece, at))
                if len(pieces) == 4:
                    if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x, _ in pieces):
                        out.append((pieces[0][1], at + len(piece)))
                    pieces = []
            else:
                pieces = []
            at += len(piece) + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    if not HIT.search(text):
        return []
    found = (emails(text) if "@" in text else [], ips(text), cards(text), phones(text))
    return [(k, a, b) for k, spans in zip(KINDS, found) for a, b in spans]


def dropped_spans(text: str) -> list[tuple[int, int]]:
    """Matches with too many digits: numbers that stand side by side and that the patterns ran together."""
    long = lambda m, most: len(NOT_DIGIT.sub("", m.group())) > most
    return [m.span() for r, most in ((CARD, 19), (PHONE, 15)) for m in r.finditer(text) if long(m, most)]


@dataclass
class Graph:
    tokens: list[tuple[int, int]]  # spans without outer punctuation
    features: np.ndarray  # bit mask of each
    label: np.ndarray  # of the base match that covers the token, or 0
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _features(t: str) -> int:
    digits = NOT_DIGIT.sub("", t)
    n = len(digits)
    letters = any(map(str.isalpha, t))
    flags = (
        True,
        "@" in t,
        "@" in t and DOMAIN.search(t, t.index("@")) is not None,
        t.count(".") == 3 and not letters and "-" not in t,
        "." in t,
        t.startswith("+"),
        "(" in t or ")" in t,
        "-" in t,
        letters,
        n <= 2,
        n in (3, 4),
        5 <= n <= 8,
        9 <= n <= 12,
        13 <= n <= 19,
        n > 19,
        13 <= n <= 19 and luhn(digits),
        n == 7 and len(t) == 8 and t[3:4] == "-",
        n == 3 and t.startswith("(") and t.endswith(")"),
        t.startswith("+") and 1 <= n <= 3 and n == len(t) - 1,
        n == len(t),
    )
    return sum(1 << i for i, x in enumerate(flags) if x)


N_FEATURES = 20


def graph(text: str, base: list[Span]) -> Graph:
    tokens: list[tuple[int, int]] = []
    raw: list[tuple[int, int]] = []
    upto = 0
    hit = HIT.search(text)
    while hit:
        begin = max(text.rfind(c, upto, hit.start()) for c in SPACES) + 1
        begin = max(begin, upto)
        stop = SPACE.search(text, hit.end())
        end = stop.start() if stop else len(text)
        piece = text[begin:end]
        a = begin + len(piece) - len(piece.lstrip(TRIM))
        b = end - len(piece) + len(piece.rstrip(TRIM))
        if a < b:
            tokens.append((a, b))
            raw.append((begin, end))
        upto = end
        hit = HIT.search(text, end)
    label = np.zeros(len(tokens), np.int64)
    starts = np.array([a for a, _ in tokens])
    ends = np.array([b for _, b in tokens])
    for k, a, b in sorted(base, key=lambda s: -KINDS.index(s[0])) if tokens else ():
        label[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = LABELS.index(k)
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if raw[i + 1][0] - raw[i][1] == 1]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b) in enumerate(tokens):
        t = text[a:b]
        digits = NOT_DIGIT.sub("", t)
        key = digits if len(digits) >= 5 and "@" not in t else t.lower()
        if key in last:
            skip.append((last[key], i))
        last[key] = i
    return Graph(tokens, np.array([_features(text[a:b]) for a, b in tokens], np.int64), label, chain, skip)


@dataclass
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


ROUNDS = 10  # times p.rounds, at most, for messages that have not converged


def _steps(edges: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of disjoint paths, in order along them: the first of each path, the second of each, and so on."""
    depth = [0] * n
    out: list[list[tuple[int, int]]] = []
    for i, j in edges:
        depth[j] = depth[i] + 1
        if depth[i] == len(out):
            out.append([])
        out[depth[i]].append((i, j))
    return [(e[:, 0], e[:, 1]) for e in map(np.array, out)]


def _pass(rest: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], pot: np.ndarray) -> np.ndarray:
    """Exact messages along paths, to each node from the one before and from the one after it."""
    msg = np.zeros((2, *rest.shape))
    for way, order, by in ((0, steps, pot), (1, [(j, i) for i, j in reversed(steps)], pot.T)):
        for src, dst in order:
            x = (rest[src] + msg[way, src])[:, :, None] + by
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            msg[way, dst] = new - new.max(1, keepdims=True)
    return msg


def beliefs(g: Graph, m: Model, p: Params = Params()) -> np.ndarray:
    """Loopy sum-product in the log domain; exact where the graph is a forest. Each round passes messages along whole
    runs of neighbours and then along whole chains of equal tokens, forward and backward, so none is too long for one."""
    bits = (g.features[:, None] >> np.arange(N_FEATURES)) & 1
    node = bits @ m.unary
    node[np.flatnonzero(g.label), g.label[g.label > 0]] += p.evidence
    if g.chain or g.skip:
        sides = [(_steps(e, len(node)), pot, np.zeros((2, *node.shape))) for e, pot in ((g.chain, m.chain), (g.skip, m.skip)) if e]
        for k in range(ROUNDS * p.rounds):
            most = 0.0
            for steps, pot, msg in sides:
                rest = node + sum(other.sum(0) for _, _, other in sides if other is not msg)
                step = _pass(rest, steps, pot) - msg
                msg += step * (1 - p.damping if k else 1.0)
                most = max(most, abs(step).max())
            if most < 1e-4 or len(sides) == 1:
                break
        node = node + sum(msg.sum(0) for _, _, msg in sides)
    q = np.exp(node - node.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def all_spans(text: str, m: Model, p: Params = Params()) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the field adds."""
    base = base_spans(text)
    if not HIT.search(text):
        return base, []
    g = graph(text, base)
    if not len(g.tokens):
        return base, []
    q = beliefs(g, m, p)
    best = q.argmax(1)
    free = (g.label == 0) & (best > 0) & (q.max(1) >= p.belief)
    linked = set(g.chain)
    added: list[Span] = []
    before = -2
    for i in np.flatnonzero(free).tolist():
        kind, (a, b) = LABELS[best[i]], g.tokens[i]
        if before == i - 1 and (i - 1, i) in linked and added[-1][0] == kind == "phone":
            added[-1] = (kind, added[-1][1], b)
        else:
            added.append((kind, a, b))
        before = i
    return base, added


def ordered(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Counts, on a hashed sample, features by base label, neighbouring labels, and labels of repeated tokens."""
    prepare(docs.sparkSession)
    n = docs.count()
    sample = docs.where(hashed_share(F.col("doc_id"), "pii", min(1.0, p.train_docs / max(n, 1)))).select("text")

    def count(batches):
        for b in batches:
            seen: dict[tuple[str, int, int], int] = {}
            for t in strings(b, "text"):
                base = base_spans(t)
                g = graph(t, base)
                # What the patterns ran together is no example of anything.
                bad = dropped_spans(t) if len(g.tokens) else []
                ok = [not any(a < y and x < b for x, y in bad) for a, b in g.tokens]
                g.chain = [(i, j) for i, j in g.chain if ok[i] and ok[j]]
                g.skip = [(i, j) for i, j in g.skip if ok[i] and ok[j]]
                nodes = zip(g.features[ok].tolist(), g.label[ok].tolist()) if ok else ()
                for what, pairs in (("node", nodes), ("chain", [(g.label[i], g.label[j]) for i, j in g.chain]), ("skip", [(g.label[i], g.label[j]) for i, j in g.skip])):
                    for x, y in pairs:
                        key = (what, int(x), int(y))
                        seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_pylist([{"what": w, "x": x, "y": y, "n": k} for (w, x, y), k in seen.items()], pa.schema([("what", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())]))

    rows = sample.mapInArrow(count, "what string, x long, y long, n long").groupBy("what", "x", "y").agg(F.sum("n").alias("n")).collect()
    k = len(LABELS)

    def pair(what: str) -> np.ndarray:
        c = np.full((k, k), 0.5)
        for r in rows:
            if r["what"] == what:
                c[r["x"], r["y"]] += r["n"]
        c = c + c.T if what == "skip" else c
        joint = c / c.sum()
        # The patterns run neighbouring numbers together and drop them, so that two kinds are never seen side by side;
        # what is rare among base labels therefore counts little against a pair.
        return np.clip(np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)), -0.5, 3)

    node = [(r["x"], r["y"], r["n"]) for r in rows if r["what"] == "node"]
    w = np.zeros((N_FEATURES, k))
    w[0, 0] = 1.0
    if node:
        x = ((np.array([a for a, _, _ in node])[:, None] >> np.arange(N_FEATURES)) & 1).astype(float)
        y = np.eye(k)[[b for _, b, _ in node]]
        c = np.sqrt(np.array([n for _, _, n in node], float))[:, None]
        seen = np.full_like(w, 1e-6)  # steps shrink with the gradients that a weight has had, so rare features learn too
        for _ in range(1500):
            z = x @ w
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            grad = x.T @ ((y - q) * c) - 0.05 * w
            seen += grad * grad
            w += 0.5 * grad / np.sqrt(seen)
    return Model(w, pair("chain"), pair("skip"))


def digest(docs: DataFrame, m: Model, p: Params = Params()) -> DataFrame:
    shared = prepare(docs.sparkSession).sparkContext.broadcast((m.unary, m.chain, m.skip))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = Model(*shared.value)
        for b in batches:
            rows = []
            for t in strings(b, "text"):
                base, added = all_spans(t, model, p)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(ordered(base).encode()).hexdigest(), ordered(base + added)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_text(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes [KIND] of its first."""
    out, upto = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= upto:
            out += [text[upto:a], f"[{k.upper()}]"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def mask(docs: DataFrame, m: Model, p: Params = Params()) -> DataFrame:
    """docs with personal data in `text` replaced, all columns kept; a null text stays null."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast((m.unary, m.chain, m.skip))
    at = docs.columns.index("text")

    def run(batches):
        model = Model(*shared.value)
        for b in batches:
            texts = [t if t is None else mask_text(t, sum(all_spans(t, model, p), [])) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
