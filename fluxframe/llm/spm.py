"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser reads characters and writes symbols (space to U+2581, dummy
prefix, runs of spaces squeezed); a space is held back until a character follows it. The pieces' machine reads symbols
and writes pieces; byte fallback is an arc of it, for a symbol without a piece of its own. For a unigram model minus the
scores weigh on its arcs. A BPE model's merges are a third, bigram machine over pieces: two neighbours weigh 0 if merging
their joined text gives just these two again, and are infinitely far apart otherwise, so exactly one path of finite
weight is left, the one that merging would give.

Composed with an input these are a lattice, built as it is searched: a state is a place with the last piece (the bigram
machine's state; none for a unigram model). The encoding is the shortest path in the tropical semiring: weights add along
a path, and of all paths into a state the least counts.

No piece goes on after a space mark that follows other characters, so inputs are cut before each run of spaces and space
marks, and the parts' shortest paths are remembered, up to a fixed number.

Defined cases: a null text is encoded as empty, to no ids, and decoded to an empty text; texts of any length are encoded
whole; equal texts get equal ids; an empty table gives no rows; ties of a unigram model go to the longer last piece. A
literal U+2581 decodes to a space, as the format has it. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# The format's piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
START, GAP, WORD = range(3)  # the normaliser's states: nothing written, a space held back, otherwise
FALLBACK, NONE = -1, -2  # in place of a piece: a symbol without one; nothing yet
INFINITE = float("inf")
SHIFT = 1 << 24
REMEMBERED = 400_000  # parts of at most 48 characters, in each of two generations


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.model_type, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        charsmap = b""
        for n, v in _fields(model):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append(f.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif n == 2:
                f = dict(_fields(v))
                self.model_type, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif n == 3:
                f = dict(_fields(v))
                charsmap = f.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if charsmap:
            raise ValueError("only models without a character map are supported")
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        # The pieces' transducer: a state's arcs by character, and under None the piece that ends there.
        self.start: dict = {}
        for p, i in self.ids.items():
            state = self.start
            for c in p:
                state = state.setdefault(c, {})
            state[None] = i
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.sizes = [*map(len, self.pieces), 1]  # the last, at -1, of a character without a piece
        self.plain = [k in (NORMAL, USER, UNUSED) for k in self.kinds]
        self.worst = min(self.scores, default=0.0) - 10.0
        mark = MARK if self.escape else " "
        first = mark if self.dummy_prefix else ""
        # The normaliser's arcs: of a state, by whether the character is a space, the next state and what is written,
        # before the character itself if that is none.
        if self.squeeze:
            self.normaliser = {START: ((WORD, first), (START, "")), GAP: ((WORD, mark), (GAP, "")), WORD: ((WORD, ""), (GAP, ""))}
        else:
            self.normaliser = {START: ((WORD, first), (WORD, first + mark)), WORD: ((WORD, ""), (WORD, mark))}
        # Space marks inside of pieces would tie neighbouring parts together.
        apart = self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cut = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+" if apart else r"(?s).+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, float] = {}
        self.spines: dict[int, tuple[list, list]] = {}

    def symbols(self, text: str, state: int = START) -> str:
        """What the normaliser writes, from a state on."""
        out = []
        for c in text:
            space = c == " "
            state, put = self.normaliser[state][space]
            out.append(put if space else put + c)
        return "".join(out)

    def merged(self, text: str) -> list[int]:
        """The pieces that merging gives: the best-scored pair first, the leftmost of equals. For short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def spine(self, t: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """The symbols at the left and at the right edge of a piece while it is merged, from the piece down to single
        characters, each with the rank of the merge that made it; ranks grow with time. Empty if merging fails."""
        got = self.spines.get(t)
        if got is None:
            text = self.pieces[t]
            parts = list(text)
            left, right = [(parts[0], -1.0e30)], [(parts[-1], -1.0e30)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    k = self.ids.get(parts[i] + parts[i + 1])
                    if k is not None and (best is None or self.scores[k] > best):
                        best, at = self.scores[k], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left.append((parts[0], -best))
                if at == len(parts) - 1:
                    right.append((parts[-1], -best))
            got = self.spines[t] = (left[::-1], right[::-1]) if len(parts) == 1 else ([], [])
        return got

    def weight(self, before: int, t: int, text: str, at: int) -> float:
        """Of piece t after piece `before`, at a place of the symbols: the bigram machine's, or the unigram model's."""
        if self.model_type == UNIGRAM:
            return -self.worst if t < 0 else 0.0 if self.kinds[t] == USER else -self.scores[t]
        if before == NONE:
            got = 0.0 if t < 0 or self.whole(t) else INFINITE
        else:
            left = self.spine(before)[1] if before >= 0 else [(text[at - 1], -1.0e30)]
            right = self.spine(t)[0] if t >= 0 else [(text[at], -1.0e30)]
            got = 0.0 if self._joins(left, right) else INFINITE
        if before != FALLBACK and t >= 0:
            if len(self.pairs) > 10 * REMEMBERED:
                self.pairs.clear()
            self.pairs[before * SHIFT + t] = got
        return got

    def _joins(self, left: list, right: list) -> bool:
        """Whether no merge crosses the boundary of two pieces.

        The merges of both pieces are undone, the latest first; at each time the symbols at the boundary would merge
        if their joint piece ranks before the merge that takes one of them away (on the left side, a merge of equal
        rank comes first, since it is the leftmost).
        """
        if not left or not right:
            return False
        i = j = 0
        until_left = until_right = float("inf")
        while True:
            (x, made_x), (y, made_y) = left[i], right[j]
            k = self.ids.get(x + y)
            if k is not None and -self.scores[k] < until_left and -self.scores[k] <= until_right:
                return False
            if made_x > made_y:
                until_left = made_x
                i += 1
            elif j + 1 < len(right):
                until_right = made_y
                j += 1
            else:
                return True

    def arcs(self, text: str, at: int) -> list[int]:
        """The pieces that can be written for the symbols from a place on, shorter ones first."""
        out = []
        state = self.start
        for c in text[at : at + self.longest]:
            state = state.get(c)
            if state is None:
                break
            if None in state:
                out.append(state[None])
        if not out or self.sizes[out[0]] > 1:
            out.insert(0, FALLBACK)
        return out

    def path(self, text: str) -> list[int]:
        """The pieces along the shortest path of the lattice over these symbols."""
        return self._best_first(text) if self.model_type == BPE else self._by_place(text)

    def _best_first(self, text: str) -> list[int]:
        """The search with the bigram machine, whose weights are never negative: the state at the least distance is left
        next, the furthest place first, then the last one found, and none twice. Only the states that it meets are made."""
        start, longest, pairs, n = self.start, self.longest, self.pairs, len(text)
        link, piece = [-1], [NONE]  # the state before, and the last piece, of each state
        queue = [(0.0, 0, 0)]  # distance, minus place, minus state
        left: set[int] = set()
        made = 0
        while queue:
            far, at, x = heappop(queue)
            at, x = -at, -x
            before = piece[x]
            if at == n:
                return self._trace(link, piece, x)
            row = before * SHIFT
            if at * SHIFT + before in left:
                continue
            left.add(at * SHIFT + before)
            state, end = start, at
            for c in text[at : at + longest]:  # the pieces' machine; the fallback arc is that of a symbol without a piece
                state = state.get(c)
                end += 1
                t = FALLBACK if state is None else state.get(None, FALLBACK)
                if t >= 0 or end == at + 1:
                    w = pairs.get(row + t)
                    if w is None:
                        w = self.weight(before, t, text, at)
                    if w < INFINITE:
                        made += 1
                        heappush(queue, (far + w, -end, -made))
                        link.append(x)
                        piece.append(t)
                if state is None:
                    break
        raise ValueError("the model's merges give no path")

    def _by_place(self, text: str) -> list[int]:
        """The search with weights of any sign: place by place. Of equal paths, that with the longer last piece counts."""
        n = len(text)
        far, link, piece = [0.0] + [INFINITE] * n, [-1] * (n + 1), [NONE] * (n + 1)
        for at in range(n):
            for t in self.arcs(text, at):
                end, w = at + self.sizes[t], far[at] + self.weight(NONE, t, text, at)
                if w < far[end]:
                    far[end], link[end], piece[end] = w, at, t
        return self._trace(link, piece, n)

    @staticmethod
    def _trace(link: list[int], piece: list[int], x: int) -> list[int]:
        out = []
        while x:
            out.append(piece[x])
            x = link[x]
        return out[::-1]

    def whole(self, t: int) -> bool:
        """Whether merging the piece's own text gives it."""
        return bool(self.spine(t)[0])

    def part_ids(self, part: str, state: int = START) -> list[int]:
        """What the shortest path writes: pieces, and for fallback arcs bytes, or once for a run of them the unknown piece."""
        text = self.symbols(part, state)
        out: list[int] = []
        at = 0
        for t in self.path(text):
            if t >= 0:
                out.append(t)
            elif self.byte_fallback:
                out += [self.bytes[x] for x in text[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += self.sizes[t]
        return out

    def _part(self, part: str) -> bytes:
        """The ids of a part as little-endian int32, from the older generation or anew. A NUL is put before a text's first
        part, which the normaliser reads from its first state; other parts begin with a space or mark."""
        got = self.older.get(part)
        if got is None:
            got = array("i", self.part_ids(part[1:]) if part[0] == "\0" else self.part_ids(part, WORD)).tobytes()
        if len(part) <= 48:
            if len(self.known) >= REMEMBERED:
                self.older = self.known
                self.known = {}
            self.known[part] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        known = self.known.get
        out = []
        parts = self.cut.findall(text)
        if parts:
            parts[0] = "\0" + parts[0]
        for part in parts:
            got = known(part)
            if got is None:
                got = self._part(part)
                known = self.known.get
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        kinds = self.plain
        if all(map(kinds.__getitem__, ids)):
            text = "".join(map(self.pieces.__getitem__, ids))
        else:
            out, held = [], bytearray()
            for i in ids:
                if self.kinds[i] == BYTE:
                    held.append(int(self.pieces[i][3:5], 16))
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                if self.kinds[i] == UNKNOWN:
                    out.append(" ⁇ ")
                elif self.kinds[i] != CONTROL:
                    out.append(self.pieces[i])
            if held:
                out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        if self.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def encode(docs: DataFrame, keep: list[str], model_path: str = MODEL) -> DataFrame:
    """The columns `keep` with n_tokens, token_ids, ids_sha256 (of little-endian int32) and round_trip.

    round_trip: decoding the ids gives the text again. The model file is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        shared = prepare(docs.sparkSession).sparkContext.broadcast(f.read())
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))

    def run(batches):
        machine = compiled(shared.value)
        for b in batches:
            texts = strings(b, "t")
            ids = [machine.encode_bytes(t) for t in texts]
            flat = np.frombuffer(b"".join(ids), "<i4")
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat))
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            same = [machine.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(n), lists, pa.array(sha), pa.array(same)], [*[f"k{i}" for i in range(len(keep))], "n_tokens", "token_ids", "ids_sha256", "round_trip"])

    fields = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return inner.mapInArrow(run, ", ".join([*fields, "n_tokens long, token_ids array<int>, ids_sha256 string, round_trip boolean"])).toDF(*keep, "n_tokens", "token_ids", "ids_sha256", "round_trip")


def decode(tokens: DataFrame, keep: list[str], model_path: str = MODEL) -> DataFrame:
    """The columns `keep` with the text of token_ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        shared = prepare(tokens.sparkSession).sparkContext.broadcast(f.read())
    inner = tokens.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("token_ids").alias("t"))

    def run(batches):
        machine = compiled(shared.value)
        for b in batches:
            texts = [None if x is None else machine.decode(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], [*[f"k{i}" for i in range(len(keep))], "text"])

    fields = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return inner.mapInArrow(run, ", ".join([*fields, "text string"])).toDF(*keep, "text")
