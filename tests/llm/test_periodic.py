import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnseek.llm import periodic
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, empty, rows_of


def smallest_period(w):
    """By the border table of the words."""
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def slow_runs(w):
    """For every period the stretches that keep it; those whose smallest period it is."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and smallest_period(w[s : i + q]) == q:
                found.append((s, i + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def found(texts):
    """Runs of each text (a list of words)."""
    owner, runs = periodic.runs_of(pa.array(texts, pa.list_(pa.binary())))
    out = [[] for _ in texts]
    for t, s, e, p in zip(owner.tolist(), *(x.tolist() for x in runs)):
        out[t].append((s, e - s, p))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_every_period(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(QUERIES["op11_periodic_runs"](spark, f"{TESTDATA}/{sf}"))
    assert got == Counter(slow_row(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 10


def random_words(rng):
    """Words of few kinds, with stretches repeated within repeated stretches."""
    out = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(len(out) + 1)
        piece = out[at : at + rng.randrange(1, 12)] or ["z"]
        out[at:at] = piece * rng.randrange(1, 9)
    return [x.encode() for x in out]


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_against_every_period(seed):
    rng = random.Random(seed)
    texts = [random_words(rng) for _ in range(300)]
    assert found(texts) == [slow_runs(t) for t in texts]


def test_texts_alone_and_in_pieces_give_the_same(monkeypatch):
    rng = random.Random(9)
    texts = [random_words(rng) for _ in range(80)]
    together = found(texts)
    assert [found([t])[0] for t in texts] == together
    monkeypatch.setattr(periodic, "_CANDIDATES", 5)
    assert found(texts) == together


def test_long_texts():
    a = [b"same"] * 50_000
    assert found([a])[0] == [(0, 50_000, 1)]
    period = [f"w{i}".encode() for i in range(997)]
    b = [b"before"] + period * 9 + period[:5] + [b"after"]
    assert found([b, a])[0] == [(1, 9 * 997 + 5, 997)]
    fib, last = [b"a"], [b"b"]
    for _ in range(14):
        fib, last = fib + last, fib
    assert found([fib])[0] == slow_runs(fib)


def test_hashes_that_fail_are_noticed(monkeypatch):
    """Thue-Morse stretches are equal by polynomials modulo 2**64; and if every stretch looks equal, results are still right."""
    tm = [b"a" if bin(i).count("1") % 2 else b"b" for i in range(4096)]
    assert found([tm])[0] == slow_runs(tm)
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(40)]
    monkeypatch.setattr(periodic._Hashes, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    assert found(texts) == [slow_runs(t) for t in texts]


def test_re_pair_gives_back_the_words():
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 4, 500), [7], np.zeros(100, np.int64), rng.integers(0, 40, 500)])
    (left, size), (rule, place), rest = periodic.re_pair(values)
    # All places of a rule hold the same words, and its halves are whole.
    for r in range(len(left)):
        at = place[rule == r]
        assert len({values[p : p + size[r]].tobytes() for p in at}) == 1 and 0 < left[r] < size[r]
    assert len(rest) < len(values) and rest[0] == 0


def test_white_space_around_words():
    texts = pa.array(["  a \n\t b\x0b", "", None, " \x0c ", "ü\u00a0v\x1cw"])
    assert periodic.words_of(texts).to_pylist() == [["a", "b"], [], [], [], ["ü\u00a0v\x1cw"]]
    assert periodic.words_of(texts.slice(1, 1)).to_pylist() == [[]]


def test_awkward_rows_and_empty_table(spark):
    df = awkward(spark)
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic.collapse(df).collect())
    expected = Counter()
    for r in df.collect():
        w = (r["text"] or "").encode().split()
        runs = slow_runs(w) if len(w) < 1000 else [(0, 120_000, 4)]
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        expected[r["doc_id"], len(w), tuple(runs), b" ".join(x for i, x in enumerate(w) if i not in dropped).decode()] += 1
    assert got == expected
    assert periodic.collapse(empty(spark)).count() == 0


def test_ids_above_two_to_the_53(spark):
    rows = [(2**60 + 1, "a " * 8), (2**60 + 3, "b"), (None, "c " * 6)]
    got = periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "collapsed").collect()
    assert Counter(tuple(r) for r in got) == Counter([(2**60 + 1, "a"), (2**60 + 3, "b"), (None, "c")])
