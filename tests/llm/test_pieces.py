import random

import numpy as np
import pytest

from driftwell.llm import pieces
from tests.llm.helpers import EDGES, documents

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(pieces.load())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_equals_the_library(machine, library):
    rng = random.Random(1)
    alphabet = "abcdefghij thenisor ▁\n 0123._-ABC éü日😀\t"
    words = [p for p, _, kind in machine.spec.pieces if kind == 1]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += [t or "" for _, t in EDGES] + [" " * 45 + "q", "a\r\n b\t\tc", "=====-----*****", "ab" * 3000]
    for text in texts:
        ids = np.frombuffer(machine.encode(text), "<i4")
        assert ids.tolist() == library.encode(text), text[:80]
        assert machine.decode(ids) == text.replace("▁", " ")


def test_scores_of_a_unigram_model():
    """A model written by hand: the path with the best sum, checked against all segmentations."""
    import struct

    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, bytes):
                out += bytes((number << 3 | 2, len(value))) + value
            elif isinstance(value, float):
                out += bytes((number << 3 | 5,)) + struct.pack("<f", value)
            else:
                out += bytes((number << 3, value))
        return out

    vocabulary = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -2.25, "ba": -1.25, "▁a": -2.75, "aba": -3.5}
    data = message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))), *((1, message((1, p.encode()), (2, s))) for p, s in vocabulary.items()), (2, message((3, 1))), (3, message((3, 1), (4, 0))))
    machine = pieces.Transducer(data)
    names = [p for p, _, _ in machine.spec.pieces]

    def best(text):
        scores = {0: 0.0}
        for i in range(1, len(text) + 1):
            scores[i] = max((scores[j] + vocabulary[text[j:i]] for j in range(i) if j in scores and text[j:i] in vocabulary), default=-1e9)
        return scores[len(text)]

    for text in ("ab", "aba", "abba", "bab a", "aababba"):
        ids = np.frombuffer(machine.encode(text), "<i4").tolist()
        assert sum(vocabulary[names[i]] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))
    assert 0 in np.frombuffer(machine.encode("azb"), "<i4").tolist()


def test_table(spark):
    docs = documents(spark, EDGES)
    rows = pieces.tokenised(docs).collect()
    assert len(rows) == len(EDGES) and all(r.round_trip for r in rows)
    assert {r.doc_id for r in rows if not r.n_tokens} == {1, 2}
    model = pieces.load()
    back = pieces.decode(pieces.encode(docs, model), model).collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert pieces.tokenised(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.Transducer(model).decode(np.array([10**6]))


def merged(machine, text):
    """The merge order itself: best score first, then leftmost."""
    parts = list(text)
    while True:
        near = [(-machine.spec.pieces[k][1], i) for i in range(len(parts) - 1) if (k := machine.merges.ids.get(parts[i] + parts[i + 1])) is not None]
        if not near:
            return parts
        i = min(near)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pair_weights_follow_the_merge_order(machine):
    rng = random.Random(7)
    names = [p for p, _, _ in machine.spec.pieces]
    real = [i for i, (p, _, kind) in enumerate(machine.spec.pieces) if kind == 1]
    for piece in rng.sample(real, 3000):
        assert (machine.merges.of(piece) is not None) == (merged(machine, names[piece]) == [names[piece]])
    short = [i for i in real if len(names[i]) < 5]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short)
        assert machine.merges.apart(a, b) == (merged(machine, names[a] + names[b]) == [names[a], names[b]]), (names[a], names[b])


def test_normaliser_with_collapsed_gaps():
    spec = pieces.Spec(collapse=True)
    for text in ("a", "  a  b ", "   ", "", "a\n  b", " a"):
        want = " ".join(x for x in text.split(" ") if x)
        got = pieces.Normaliser(spec).compose(text, pieces.BEFORE)[0]
        assert got == (("▁" + want.replace(" ", "▁")) if want else "")
