"""Benchmark decontamination: a prefix-filtered join of word shingles, checked word for word.

Each window of an item is a set of shingles. To hold the window, a text must hold all of them,
so the first in the order of rarity (a prefix of length one) finds every candidate. Rarity is counted over all windows of
the benchmark, ties by hash, so that windows that overlap mostly share their prefix. Only prefixes
meet the corpus. A shingle at word p of a text puts the window's start at p less the shingle's offset: the start
must not come before the text (position) nor the end after it (length). A candidate is a hit if the text
has the window's words there, all of them.

The corpus is read once and never shuffled: bounds and words are compared within the broadcast join, and what it
gives are occurrences. The benchmark side is dealt into blocks of a bounded size, with a pass over the corpus for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnseek.functions.columns import fresh_names
from tarnseek.llm.common import ascii_lower, let, row_key, text_of, written

WINDOW = 10
SHINGLE = 4
#: A block of the benchmark side that is broadcast: at most about this many bytes of windows.
BLOCK_BYTES = 32 << 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text once A-Z are lower case: runs of a-z, 0-9 and all that isn't ASCII."""
    return F.array_remove(F.split(ascii_lower(text), _SEPARATORS), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in the order of their places."""

    def run(i: Column) -> Column:
        return F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)])

    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), run)
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(runs)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, text, n): windows of ten words of each item; a shorter one is one window, one without words none."""
    items = benchmark.select("item_id", words_of(text_of()).alias("w"))
    whole = F.array(F.col("w"))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.slice("w", i, WINDOW))
    found = items.where(F.size("w") > 0).select("item_id", F.explode(F.when(F.size("w") < WINDOW, whole).otherwise(windows)).alias("words"))
    return found.select("item_id", "words", F.array_join("words", " ").alias("text"), F.size("words").alias("n"))


def _blocks(table: DataFrame, size: Column, by: str) -> list[DataFrame]:
    """``table`` in parts of about BLOCK_BYTES at most, each small enough to broadcast."""
    total = table.agg(F.sum(size)).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    return [table.where(F.pmod(F.xxhash64(by), F.lit(count)) == i) for i in range(count)]


def _item_shingles(windows: DataFrame) -> DataFrame:
    """(text, n, offset, k, hash, shingle) of every window (words, text, n): its runs of four words, or of all if it has fewer."""
    k = F.least(F.col("n"), F.lit(SHINGLE))
    runs = reduce(lambda out, size: out.when(k == size, _shingles(F.col("words"), size)), range(1, SHINGLE + 1), F)
    rows = windows.select("words", "text", "n", k.alias("k"), F.posexplode(runs).alias("offset", "hash"))
    return rows.select("text", "n", "offset", "k", "hash", F.array_join(F.slice("words", F.col("offset") + 1, F.col("k")), " ").alias("shingle"))


def _prefixes(shingles: DataFrame) -> DataFrame:
    """(text, n, offset, k, hash): the rarest shingle of each window, by how often the benchmark's windows have it."""
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("many"))
    rarest = F.min_by(F.struct("offset", "k", "hash"), F.struct("many", "hash", "offset")).alias("s")
    return shingles.join(counts, "shingle").groupBy("text", "n").agg(rarest).select("text", "n", "s.*")


def corpus_rows(docs: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each text, with a null window, and one for each place where a window of ``prefixes`` (text, n, offset, k, hash) stands.

    Columns doc_id, row_key, n_words, start, n and text (the window's).
    """
    words = docs.select("doc_id", row_key().alias("row_key"), words_of(text_of()).alias("w"))

    def all_sizes(w: Column) -> Column:
        return F.concat(F.array(F.lit(None).cast("bigint")), *[_shingles(w, k) for k in sizes])

    # The first entry stands for the text itself; runs of one size follow those of the size before.
    runs = words.select("doc_id", "row_key", "w", let(F.col("w"), all_sizes).alias("runs"))
    rows = runs.select("doc_id", "row_key", "w", F.posexplode("runs").alias("entry", "hash"))
    base, at = F.lit(1), F.col("entry") - 1
    for size in sizes[:-1]:
        base = base + F.greatest(F.size("w") - size + 1, F.lit(0))
        at = F.when(F.col("entry") >= base, F.col("entry") - base).otherwise(at)
    rows = rows.select("doc_id", "row_key", "w", "hash", at.alias("at"))
    prefixes = prefixes.select(F.col("hash").alias("known"), "offset", "n", "text")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.size("w"))
    spelt = F.array_join(F.slice("w", start + 1, F.col("n")), " ") == F.col("text")
    # Bounds first: a slice needs a start within the text.
    held = F.when(inside, spelt).otherwise(F.lit(False))
    found = rows.join(F.broadcast(prefixes), (F.col("hash") == F.col("known")) & held, "left")
    found = found.where(F.col("hash").isNull() | F.col("text").isNotNull())
    return found.select("doc_id", "row_key", F.size("w").cast("long").alias("n_words"), start.alias("start"), "n", "text")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the benchmark and the texts share, as three tables.

    (doc_id, row_key, start, n, text): distinct occurrences of item windows, start counted in words from 0, n the window's words;
    (text, item_id): the items of each window; (doc_id, row_key, n_words): a row for each row of ``docs``.
    """
    windows = item_windows(benchmark)
    items = written(windows.select("text", "item_id").distinct(), "window-items")
    windows = written(windows.select("words", "text", "n").distinct(), "windows")
    prefixes = written(_prefixes(written(_item_shingles(windows), "window-shingles")), "prefixes")
    sizes = [r[0] for r in prefixes.select("k").distinct().orderBy("k").collect()]
    blocks = _blocks(prefixes, F.octet_length("text") + 48, "text") or [prefixes]
    first, *others = [corpus_rows(docs, block, sizes) for block in blocks]
    seen = written(reduce(DataFrame.unionByName, [first, *[p.where("text is not null") for p in others]]), "occurrences")
    rows = seen.where("text is null").select("doc_id", "row_key", "n_words")
    return seen.where("text is not null").select("doc_id", "row_key", "start", "n", "text").distinct(), items, rows


def _covered(spans: Column) -> Column:
    """How many places sorted (start, end) spans cover."""
    first = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, first, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_words, n_hit, item_ids (sorted strings) and contaminated.

    A word within any occurrence of an item's window is hit. Null texts have no words; items without an id
    hit words but aren't listed; repeated items count once. Rows are told apart by id and text, so repeated rows get
    equal results. Other columns aren't read. An empty table gives an empty one; an empty benchmark hits nothing.
    """
    found, items, rows = hits(docs, benchmark)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    hit = found.groupBy("doc_id", "row_key").agg(_covered(spans).alias("n_hit"))
    held = found.select("doc_id", "row_key", "text").distinct().join(items, "text")
    named = held.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    facts = hit.join(named, hit["doc_id"].eqNullSafe(named["doc_id"]) & (hit["row_key"] == named["row_key"]))
    facts = facts.select(hit["doc_id"].alias("hit_doc"), hit["row_key"].alias("hit_key"), "n_hit", "item_ids")
    rows = rows.join(facts, rows["doc_id"].eqNullSafe(facts["hit_doc"]) & (rows["row_key"] == facts["hit_key"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns."""
    occurrences, _, _ = hits(docs, benchmark)
    bad = written(occurrences.select("doc_id", "row_key").distinct(), "contaminated")
    doc, key, row = fresh_names(docs, "bad_doc", "bad_key", "own_key")
    bad = bad.select(F.col("doc_id").alias(doc), F.col("row_key").alias(key))
    rows = docs.withColumn(row, row_key())
    clean = rows.join(bad, rows["doc_id"].eqNullSafe(bad[doc]) & (F.col(row) == F.col(key)), "left_anti")
    return clean.select(docs.columns)
