"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits that stand for letters) and a lexicon
of words and beginnings of words is found in them by an Aho-Corasick automaton. Matches inside an
exception phrase don't count. The sum of weights, alone and per word of the text, goes through a
logistic curve. Lexicon, exceptions and curve are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnseek.llm.common import written

#: The rows of each label that are learned from, at most: those whose ids have the smallest hashes.
FIT_ROWS = 6_000
#: Letters of a word's beginning that may be an entry, and the entries kept at most.
PREFIXES = (4, 5, 6, 7, 8)
LEXICON = 2_000
#: An entry is in at least one toxic row of so many, and this much likelier there, as a logarithm.
MIN_SHARE = 200
MIN_WEIGHT = 3.0
THRESHOLD = 0.7

#: Look-alikes of Latin letters. Fixed values.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits and signs that stand for letters within a word. Fixed values.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_SUBSTITUTED = re.compile(r"[0134578@$!]")
#: A word in which something may stand for a letter: it starts with a letter or a sign or digit before one, and ends with a letter or digit.
_MIXED = re.compile(r"(?<![^\W_])[a-z0134578@$!]*[a-z][a-z0134578@$!]*")
_NOT_WORD = re.compile(r"[\W_]+")
_LOOK_TABLE = str.maketrans(LOOK_ALIKES)
_SUBSTITUTE_TABLE = str.maketrans(SUBSTITUTES)


def _spelt_out(m: re.Match) -> str:
    """A word with its substitutes as letters; marks that end it are marks."""
    word = m[0].rstrip("!$@")
    return word.translate(_SUBSTITUTE_TABLE) + " " * (len(m[0]) - len(word))


def fold(text: str | None) -> str:
    """Words of the text between single spaces, with one before the first and after the last; no words give one space."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_LOOK_TABLE))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
        text = text.translate(_LOOK_TABLE)
    if _SUBSTITUTED.search(text):
        text = _MIXED.sub(_spelt_out, text)
    words = _NOT_WORD.sub(" ", text).strip()
    return f" {words} " if words else " "


@dataclass
class Model:
    """Entries (" word " or " beginn") with weights, exception phrases (" two words "), and the curve's three numbers."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        if len(found):
            found.make_automaton()
        return found


def matched(automaton, folded: str) -> float:
    """The weights of the words found, the highest entry of each word, but for those that an exception phrase covers."""
    if not len(automaton):
        return 0.0
    words: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excepted.append((start, end))
        else:
            words[start] = max(weight, words.get(start, 0.0))
    for first, last in excepted:
        for start in [s for s in words if first <= s < last]:
            del words[start]
    return sum(words.values())


def _features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / words) if words else 0.0


def score(model: Model, automaton, text: str | None) -> float:
    """0 to 1. A text without words has the score of one in which nothing is found."""
    folded = fold(text)
    a, b = _features(matched(automaton, folded), folded.count(" ") - 1)
    z = model.curve[0] + model.curve[1] * a + model.curve[2] * b
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _fit_curve(values: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a small penalty so that clean cuts have finite weights."""
    x = np.column_stack([np.ones(len(values)), values])
    at = np.zeros(x.shape[1])
    penalty = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (label - p) - penalty @ at)
        at += step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in at)


def _entries(folded: str) -> set[str]:
    """What could be an entry for one of the text's words."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` ids of each label, by the hash of the id. Unlabelled rows and null ids are left out.

    Copies count once, or else the words of a text that was copied often would look telling.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(rows).union(known.where("toxic = 0").orderBy(*order).limit(rows))
    # At most 2 * rows ids: written first, so that its size is known to be small.
    picked = F.broadcast(written(picked, "picked"))
    return written(docs.select("doc_id", "text").join(picked, "doc_id").select("text", "toxic").distinct(), "sample")


def learn(rows: DataFrame, lexicon: int = LEXICON) -> Model:
    """A model from (text, toxic). Entries are counted by Spark; only those that tell toxic rows come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                (pos if toxic else neg).update(_entries(fold(text)))
            names = list(pos.keys() | neg.keys())
            yield pd.DataFrame({"entry": names, "pos": [pos[n] for n in names], "neg": [neg[n] for n in names]})

    n_pos, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_neg = n - n_pos
    if not n_pos or not n_neg:
        return Model()
    counts = rows.mapInPandas(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log(((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1)))
    good = counts.where(F.col("pos") >= max(3, n_pos / MIN_SHARE)).withColumn("weight", odds).where(F.col("weight") >= MIN_WEIGHT)
    found = good.orderBy(F.desc(F.col("weight") * F.sqrt("pos")), "entry").limit(20 * lexicon).collect()
    weights: dict[str, float] = {}
    # A shorter beginning stands for all words that go on from it, if it tells as well as they do.
    for r in sorted(found, key=lambda r: (len(r["entry"].rstrip()), r["entry"])):
        shorter = [weights[r["entry"][:k]] for k in range(2, len(r["entry"])) if r["entry"][:k] in weights]
        if len(weights) < lexicon and (not shorter or r["weight"] > max(shorter) + 1):
            weights[r["entry"]] = float(r["weight"])
    model = Model(weights)
    model.exceptions = _exceptions(rows, model)
    table = rows.mapInPandas(_measured(model), "a double, b double, toxic int").groupBy("a", "b", "toxic").count().toPandas()
    many = np.repeat(np.arange(len(table)), table["count"])
    model.curve = _fit_curve(table[["a", "b"]].to_numpy()[many], table["toxic"].to_numpy()[many])
    return model


def _exceptions(rows: DataFrame, model: Model) -> list[str]:
    """Pairs of words, one of them an entry's, that clean rows have at least three times and toxic rows never."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                folded, found = fold(text), set()
                for end, (size, _) in automaton.iter(folded) if len(automaton) else ():
                    start = end - size + 1
                    stop = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    if before >= 0:
                        found.add(folded[before : stop + 1])
                    after = folded.find(" ", stop + 1)
                    if after >= 0:
                        found.add(folded[start : after + 1])
                out += [(p, int(toxic)) for p in found]
            yield pd.DataFrame(out, columns=["phrase", "toxic"])

    counts = rows.mapInPandas(pairs, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    return [r[0] for r in counts.where("pos = 0 AND n >= 3").orderBy(F.desc("n"), "phrase").limit(LEXICON).collect()]


def _measured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            folded = [fold(t) for t in batch["text"]]
            found = [_features(matched(automaton, f), f.count(" ") - 1) for f in folded]
            yield pd.DataFrame(found, columns=["a", "b"]).round(6).assign(toxic=batch["toxic"].to_numpy())

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learned from: crc32 of the id as text leaves 1 by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row, from the text alone. Null texts count as empty; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            scores = [score(model, automaton, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Learned from labelled rows that aren't held out.

    Without labels of both kinds nothing is learned and all scores are low. Repeated rows stay; an empty table gives an empty one.
    """
    model = learn(sample(docs, labels.where(~held_out(F.col("doc_id")))))
    rows = score_texts(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
