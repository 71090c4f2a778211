"""Spelling variants: words that differ by one letter, found on a bit-sliced index of letters by place.

The index of a shard holds, for each (place, letter), the set of words with that letter there as a row of
bits. A query goes over its letters once and keeps the words that agree so far and those with one error so
far (a letter replaced, or one more or one less, by rows of shifted places), 64 words an operation.

Two words one edit apart share their first or their last letters, so each word goes to two sides: shards by its
first and by its last letters. A pair that shares the first counts on that side alone. Shards are of one
length and bounded in letters: where many words begin or end alike, the members are dealt over several parts
and the queries over several slices, and each slice searches each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnseek.llm.arrow_groups import slices
from tarnseek.llm.common import ascii_lower, text_of, written

#: What a word is made of, besides A-Z in lower case: letters, and the two signs among them. A fixed value.
LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
#: Letters of the words in one shard, and 64-bit words of one set of a batch of queries.
SHARD_LETTERS = 1 << 15
_BATCH = 1 << 16
_FIRST, _LAST = 0, 1
_MEMBER, _SEARCH = 0, 1


def runs_of(docs: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc_id, run): every maximal run of at least ``min_letters`` letters of the whole texts, A-Z in lower case. Null texts have none."""
    found = F.regexp_extract_all(ascii_lower(text_of()), F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def vocabulary(words: Column, rows: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct ``words`` of ``rows`` that are long and frequent enough. Counted with map-side partials."""
    counts = rows.select(words.alias("word")).where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


class PlaceIndex:
    """Words of one length as bits by (place, letter). Bits are in the order of the words given."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, len(words[0])
        self.wide = -(-len(words) // 64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), self.length)
        codes = (np.arange(self.length, dtype=np.int64) << 21)[None, :] | letters
        self.codes, row = np.unique(codes, return_inverse=True)
        # One more row, of no word, for letters that no word has at the place.
        present = np.zeros((len(self.codes) + 1, self.wide * 64), bool)
        present[row.reshape(codes.shape), np.arange(len(words))[:, None]] = True
        self.bits = np.packbits(present, axis=1, bitorder="little").view("<u8")
        everyone = np.zeros(self.wide * 64, bool)
        everyone[: len(words)] = True
        self.all = np.packbits(everyone, bitorder="little").view("<u8")

    def _rows(self, place: int, letters: np.ndarray) -> np.ndarray:
        """The words that have ``letters`` at ``place``, a set for each query."""
        code = (place << 21) | letters.astype(np.int64)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return self.bits[np.where(self.codes[at] == code, at, len(self.codes))]

    def near(self, letters: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries of one length (a row of code points each): the words exactly one edit apart, and those with the same first ``shared`` letters."""
        length = letters.shape[1]
        same = np.repeat(self.all[None, :], len(letters), axis=0)
        error, start = np.zeros_like(same), same
        for i in range(length):
            here = self._rows(i, letters[:, i])
            if length == self.length:  # a letter replaced
                error = (error & here) | (same & ~here)
            elif length < self.length:  # the word has one more, before this letter or earlier
                error = (error | same) & self._rows(i + 1, letters[:, i])
            else:  # the word lacks this letter or an earlier one
                error = (error & self._rows(i - 1, letters[:, i])) | same if i else same
            same = same & here
            if i + 1 == shared:
                start = same
        if length < self.length:
            error = error | same
        return error, start


def _found(index: PlaceIndex, counts: np.ndarray, words: list[str], side: int, shared: int) -> Iterator[tuple]:
    """Of queries of one length: (numbers of those with near words, how many, the best one's count and word)."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    step = max(1, _BATCH // index.wide)
    for at in range(0, len(words), step):
        near, start = index.near(letters[at : at + step], shared)
        near &= start if side == _FIRST else ~start
        many = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
        has = np.flatnonzero(many)
        if len(has):
            # Members are in order of count and word, so the best is the lowest bit.
            word = (near[has] != 0).argmax(axis=1)
            low = near[has, word]
            best = word * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
            yield at + has, many[has], counts[best], [index.words[b] for b in best.tolist()]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search(shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, counts, members = None, None, np.zeros(0, np.int64), []
        for key, rows in slices(batches, ["side", "length", "bucket", "part", "slice", "role", "size"]):
            if key[:5] != shard:
                shard, index, members = key[:5], None, []
            if key[5] == _MEMBER:
                members += zip((-rows.column("n").to_numpy()).tolist(), rows.column("word").to_pylist())
                continue
            if index is None:
                if not members:
                    continue
                members.sort()
                counts = -np.array([n for n, _ in members], np.int64)
                index = PlaceIndex([w for _, w in members])
            words = rows.column("word").to_pylist()
            for at, many, best_n, best in _found(index, counts, words, key[0], shared):
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at.tolist()]), pa.array(many), pa.array(best_n), pa.array(best)], schema=_NEAR)

    return run


def near_words(vocab: DataFrame, min_letters: int = MIN_LETTERS, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocab`` (word, n; distinct) that have near words.

    best is the near word of largest n, of equal ones the first in code-point order. Words have at
    least ``min_letters`` letters, which is 2 or more.
    """
    shared = min_letters // 2
    if shared < 1:
        raise ValueError("words of one letter have no letters to share")
    sides = F.array(
        F.struct(F.lit(_FIRST).alias("side"), F.left("word", F.lit(shared)).alias("key")),
        F.struct(F.lit(_LAST).alias("side"), F.right("word", F.lit(shared)).alias("key")),
    )
    vocab = vocab.select("word", "n", F.char_length("word").alias("size"))
    per_length = vocab.groupBy("size").agg(F.ceil(F.count("*") * F.col("size") / shard_letters).alias("buckets"))
    per_length = written(per_length.withColumnRenamed("size", "length"), "spelling-lengths")
    rows = vocab.select("word", "n", "size", F.explode(sides).alias("at")).select("word", "n", "size", "at.*")
    bucket = F.pmod(F.xxhash64("key"), F.col("buckets"))

    lengths = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    searches = rows.withColumn("length", lengths).join(per_length, "length").withColumn("bucket", bucket)
    where = ["side", "length", "bucket"]
    # A bucket's members are those of its searches that have its length themselves.
    full = searches.groupBy(where).agg(F.count_if(F.col("size") == F.col("length")).alias("members"), F.count("*").alias("searches"))
    cut = [F.ceil(F.col(c) * F.col("length") / (2 * shard_letters)).cast("int").alias(name) for c, name in (("members", "parts"), ("searches", "slices"))]
    full = written(full.where("members > 0").select(*where, *cut), "spelling-shards")
    searches = searches.join(full, where)
    part, piece = (F.pmod(F.xxhash64("word"), F.col(c)).cast("int") for c in ("parts", "slices"))
    over = {c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "slices")}
    shard = [*where, "part", "slice"]
    columns = [*shard, "role", "size", "word", "n"]
    dealt = searches.where("size = length").withColumns({"part": part, "role": F.lit(_MEMBER)}).withColumn("slice", over["slices"]).select(columns)
    searches = searches.withColumns({"slice": piece, "role": F.lit(_SEARCH)}).withColumn("part", over["parts"]).select(columns)
    together = dealt.union(searches).repartition(*shard).sortWithinPartitions(*shard, "role", "size")
    found = together.mapInArrow(_search(shared), "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("at"))
    return found.select("word", "n_near", (-F.col("at.order")).alias("best_n"), F.col("at.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): forms followed to the last, twice as far in each round. Counts only grow along forms, so there are no circles."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def variants(vocab: DataFrame, ratio: int = RATIO, min_letters: int = MIN_LETTERS, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of ``vocab`` (word, n; distinct words).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of
    largest n (ties: the smallest by code points) if that is at least ``ratio`` times the word's own; else null. ``ratio``
    is over 1. root follows forms to the last, and is the word itself without one. An empty vocabulary gives an empty table.
    """
    vocab = written(vocab.select("word", "n"), "spelling-vocabulary")
    table = written(vocab.join(near_words(vocab, min_letters, shard_letters), "word", "left"), "spelling-near")
    is_form = F.col("best_n") >= ratio * F.col("n")
    table = table.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    roots = _roots(table.where("form IS NOT NULL"))
    whole = table.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
