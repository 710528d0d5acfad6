"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three machines:

* the normaliser, a transducer of three states (before the text, inside, in a gap) that writes the
  space mark for white space, the dummy prefix, and collapses gaps where the model asks for it;
* the pieces, a trie whose ends write a piece and return to its root, with byte fallback as the arc for a
  character that no piece is;
* the weights, an acceptor over pieces. For a unigram model it has one state and an arc weighs
  minus its piece's score. For a merge (BPE) model its states are the pieces, and the arc from one to
  the next weighs 0 if merging never joins anything across their border, else infinity.

An input is composed with the normaliser, then with the pieces, then with the weights, and the
shortest path in the tropical semiring (least sum of weights) is the library's encoding; for a
merge model it is the only path of finite weight. The arcs of the third machine are compiled from how each piece is built:
the last two parts that merge into it, the parts of those along the border, and when each is there. Two
pieces stay apart if no two parts that are there at the same time merge before either is used up.

Input is composed in chunks that no piece can cross (at space marks and at characters outside
all pieces), and chunks seen before come from a cache of bounded size.

Null texts count as empty; the empty text has no ids. A literal space mark (U+2581) is decoded as a
space, as by the library. Ids out of range raise ValueError. Repeated rows give repeated results;
other columns are not read. Long chunks take time linear in their length. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.common import map_texts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 150_000  # chunks in each of a cache's two generations
DOOR = 1 << 21  # marks for chunks met once, a power of two
PAIRS = 500_000  # weights of pairs that are kept

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
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
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError("not a model file")


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = _UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True
    rules: bytes = b""


def read_model(data: bytes) -> Spec:
    s = Spec()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            s.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            s.kind, s.byte_fallback = own.get(3, _UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            s.rules, s.dummy_prefix, s.collapse, s.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if not s.pieces or s.kind not in (_UNIGRAM, _BPE):
        raise ValueError("only unigram and merge models have a transducer here")
    if s.rules or not s.escape:
        raise ValueError("only the identity normaliser with escaped spaces is compiled")
    s.unknown = next((i for i, p in enumerate(s.pieces) if p[2] == _UNKNOWN), 0)
    return s


class Paths(dict):
    """Shortest paths of ``lead`` and a chunk, from one state of the normaliser.

    Two generations bound it: a full one ages, the aged one goes. A chunk is kept from its second
    miss on, so that those that occur once take no room.
    """

    def __init__(self, machine: Transducer, state: int, lead: str = ""):
        self.machine, self.state, self.lead, self.old, self.met = machine, state, lead, {}, bytearray(DOOR)

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.machine.path(self.lead + chunk, self.state)
            place = hash(chunk) & (DOOR - 1)
            if not self.met[place]:
                self.met[place] = 1
                return got
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.old, self.met = dict(self), bytearray(DOOR)
                self.clear()
            self[chunk] = got
        return got


BEFORE, INSIDE, GAP = range(3)


class Normaliser:
    """For each state what a space and what any other character writes, and the state after it."""

    def __init__(self, spec: Spec):
        first = SPACE if spec.dummy_prefix else ""
        if spec.collapse:
            self.arcs = {BEFORE: (("", BEFORE), (first, INSIDE)), INSIDE: (("", GAP), ("", INSIDE)), GAP: (("", GAP), (SPACE, INSIDE))}
        else:
            self.arcs = {BEFORE: ((first + SPACE, INSIDE), (first, INSIDE)), INSIDE: ((SPACE, INSIDE), ("", INSIDE))}

    def compose(self, text: str, state: int) -> tuple[str, int]:
        """What the text's only path writes, and its last state."""
        out = []
        for c in text:
            space, other = self.arcs[state]
            if c == " ":
                written, state = space
                out.append(written)
            else:
                written, state = other
                out.append(written + c)
        return "".join(out), state


class Merges:
    """Which neighbours stay apart under the merge order, from how pieces are built.

    Time runs from the best score down. A character is there from the start; a piece from when its
    two last parts have merged, until it merges into a larger one.
    """

    def __init__(self, names: list[str], scores: list[float], ids: dict[str, int]):
        self.names, self.scores, self.ids = names, scores, ids
        self.built: dict[int, tuple | None] = {}  # piece -> since when it is there, spines to the left and right

    def of(self, piece: int) -> tuple | None:
        """(time, left spine, right spine); a spine lists (part, its time, the time it is used up), innermost first. None: merging never gives the piece."""
        if piece in self.built:
            return self.built[piece]
        name, got = self.names[piece], None
        if len(name) == 1:
            one = ((piece, math.inf, -math.inf),)
            got = math.inf, one, one
        for k in range(1, len(name)):
            left, right = self.ids.get(name[:k]), self.ids.get(name[k:])
            if left is None or right is None or (a := self.of(left)) is None or (b := self.of(right)) is None or self._joins(a[2], b[1], False):
                continue
            since = min(self.scores[piece], a[0], b[0])
            used = lambda spine: (*spine[:-1], (spine[-1][0], spine[-1][1], since), (piece, since, -math.inf))
            got = since, used(a[1]), used(b[2])
            break
        self.built[piece] = got
        return got

    def _joins(self, left: tuple, right: tuple, whole: bool) -> bool:
        """Whether parts on the two sides of a border merge; with ``whole``, the two pieces themselves count too."""
        i = j = 0
        while True:
            (a, a_since, a_until), (b, b_since, b_until) = left[i], right[j]
            last = i == len(left) - 1 and j == len(right) - 1
            if last and not whole:
                return False
            joint = self.ids.get(self.names[a] + self.names[b])
            if joint is not None:
                at = min(self.scores[joint], a_since, b_since)
                if at > a_until and at >= b_until:  # of equal scores the leftmost merges first
                    return True
            if last:
                return False
            if a_until >= b_until:
                i += 1
            else:
                j += 1

    def apart(self, left: int, right: int) -> bool:
        a, b = self.of(left), self.of(right)
        return a is not None and b is not None and not self._joins(a[2], b[1], True)


class Transducer:
    """A compiled model."""

    def __init__(self, data: bytes):
        self.spec = s = read_model(data)
        self.bytes_ = [-1] * 256
        self.normaliser = Normaliser(s)
        real = [(p, i) for i, (p, _, kind) in enumerate(s.pieces) if kind in (_NORMAL, _USER) and p]
        for i, (p, _, kind) in enumerate(s.pieces):
            if kind == _BYTE:
                self.bytes_[int(p[3:5], 16)] = i
        if s.byte_fallback and -1 in self.bytes_:
            raise ValueError("byte pieces are missing")
        ids, chars, scores = dict(real), {c for p, _ in real for c in p}, [p[1] for p in s.pieces]
        self.pairs = s.kind == _BPE
        if self.pairs and not chars <= set(ids):
            raise ValueError("a merge model must hold each character of its pieces")
        self.size, self.codes = len(s.pieces), [i.to_bytes(4, "little") for i in range(len(s.pieces))]
        self.trie: dict = {}  # character -> (id of the piece that ends here or -1, the steps from here)
        for p, i in real:
            node, last = self.trie, None
            for c in p:
                if c not in node:
                    node[c] = (-1, {})
                last, node = node, node[c][1]
            last[p[-1]] = (i, node)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p, _ in real)
        self.by_line = self.splits and not s.collapse and "\n" not in chars
        if not self.pairs and max(scores[i] for _, i in real) > 0:
            raise ValueError("a unigram model's scores must not be above 0")
        self.start = self.size if self.pairs else 0  # the weights' state at the start and after fallback
        self.merges = Merges([p[0] for p in s.pieces], scores, ids)
        self.weights: dict[int, float] = {} if self.pairs else {i: -scores[i] for _, i in real}  # state * size + piece
        self.lost = 0.0 if self.pairs else 10.0 - min((scores[i] for _, i in real), default=0.0)  # of a character that is no piece
        self.first, self.bare, self.spaced = Paths(self, BEFORE), Paths(self, INSIDE), Paths(self, INSIDE, " ")
        self.newline = self._fallback("\n")
        self.forms = [self._form(i) for i in range(len(s.pieces))]

    def _form(self, i: int) -> bytes:
        p, _, kind = self.spec.pieces[i]
        if kind == _BYTE:
            return bytes((int(p[3:5], 16),))
        return b" \xe2\x81\x87 " if kind == _UNKNOWN else b"" if kind == _CONTROL else p.encode()

    def _fallback(self, char: str) -> bytes:
        ids = [self.bytes_[b] for b in char.encode("utf-8", "replace")] if self.spec.byte_fallback else [self.spec.unknown]
        return np.array(ids, "<i4").tobytes()

    def _weigh(self, state: int, piece: int) -> float:
        """The weight of an arc of a merge model's acceptor."""
        if len(self.weights) >= PAIRS:
            self.weights.clear()
        fits = self.merges.of(piece) is not None if state == self.start else self.merges.apart(state, piece)
        out = self.weights[state * self.size + piece] = 0.0 if fits else math.inf
        return out

    def path(self, chunk: str, state: int) -> bytes:
        """Ids (little-endian int32) of the shortest path through the composition of a chunk with all machines."""
        return self.shortest_path(self.normaliser.compose(chunk, state)[0])

    def shortest_path(self, symbols: str) -> bytes:
        """The composition of normalised symbols with pieces and weights is built as far as the search goes.

        States (place, state of the weights) are settled in order of their least sum, and of equal
        sums the furthest first. No weight is below 0; an arc of a merge model is weighed when its turn comes.
        """
        n, trie, size, weights, start, pairs = len(symbols), self.trie, self.size, self.weights, self.start, self.pairs
        back: dict[int, tuple] = {}  # settled state -> the arc it came by
        arcs: list[tuple] = [(0.0, 0, 0, start, -1)]  # sum, minus the place it leads to, the state it leaves, piece
        while arcs:
            total, k, j, state, piece = heappop(arcs)
            k, to = -k, start
            if pairs and piece >= 0:
                w = weights.get(state * size + piece)
                if w is None:
                    w = self._weigh(state, piece)
                if w:
                    continue
                to = piece
            key = k * (size + 1) + to
            if key in back:
                continue
            back[key] = j, state, piece
            if k == n:
                break
            j, node, single = k, trie, False
            while k < n and (step := node.get(symbols[k])) is not None:
                k += 1
                piece, node = step
                if piece >= 0:
                    single = single or k == j + 1
                    heappush(arcs, (total if pairs else total + weights[piece], -k, j, to, piece))
            if not single:
                heappush(arcs, (total + self.lost, -j - 1, j, to, -1))
        else:
            raise ValueError("no finite path")
        out, codes = [], self.codes
        while k:
            j, state, piece = back[k * (size + 1) + to]
            out.append(codes[piece] if piece >= 0 else self._fallback(symbols[j]))
            k, to = j, state
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.splits:
            return self.path(text, BEFORE)
        if not self.by_line or SPACE in text:
            out, state = [], BEFORE
            for chunk in _CHUNKS.findall(text):
                out.append((self.first if state == BEFORE else self.bare)[chunk])
                if state == BEFORE:
                    state = self.normaliser.compose(chunk, state)[1]
                    state = INSIDE if state == GAP else state
            return b"".join(out)
        bare, spaced, out = self.bare.__getitem__, self.spaced.__getitem__, []
        for n, line in enumerate(text.split("\n")):
            first, *words = line.split(" ")
            start = bare if n else self.first.__getitem__
            if "" in words or (not n and not first):
                begin, *chunks = _CHUNKS.findall(line) or [""]
                if not n and not line:  # the dummy prefix stands before the line's end
                    out.append(self.shortest_path(self.normaliser.compose("\n", BEFORE)[0][:-1]))
                else:
                    out.append(start(begin) + b"".join(map(bare, chunks)))
            else:
                out.append((start(first) if first else b"") + b"".join(map(spaced, words)))
        return self.newline.join(out)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.forms)):
            raise ValueError("an id is out of range")
        text = b"".join(map(self.forms.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


_CHUNKS = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")  # with collapsing, spaces belong to the word after them


@functools.lru_cache(maxsize=4)
def _compiled(data: bytes) -> Transducer:
    return Transducer(data)


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text and the ids of each text."""

    def run(part, texts):
        t = _compiled(model)
        return {"doc_id": part.column("doc_id"), "text": part.column("text"), "ids": _lists([t.encode(x) for x in texts]).cast(pa.list_(pa.int32()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, text string, ids array<int>", limit=2_000_000)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``encoded`` (doc_id, text, ids) with the text that the ids stand for."""

    def run(part, texts):
        t = _compiled(model)
        ids = part.column("ids")
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
        return {"doc_id": part.column("doc_id"), "text": part.column("text"), "ids": ids.cast(pa.list_(pa.int32())), "decoded": [t.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_texts(encoded, run, f"doc_id {kind}, text string, ids array<int>, decoded string", limit=2_000_000)


def tokenised(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, the decoded text's sha256, and whether it is the text again.

    Encodes and then decodes from the ids alone, in one pass over the texts.
    """
    model = load(path)

    def run(part, texts):
        t = _compiled(model)
        made = [t.encode(x) for x in texts]
        read = [t.decode(np.frombuffer(e, "<i4")) for e in made]
        return {
            "doc_id": part.column("doc_id"), "n_tokens": [len(e) // 4 for e in made], "ids": _lists(made).cast(pa.list_(pa.int32())),
            "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in read], "round_trip": [a == b for a, b in zip(texts, read)],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean", limit=1_000_000)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))
