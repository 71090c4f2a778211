"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Symbols of many words lie in one flat array. In each round every word finds the least rank
among its neighbouring pairs (a segmented minimum), merges all pairs of that rank at once,
leftmost first, and the array is compacted, until no pair is left. Words are encoded once
each; a text is then put together from its words' ids.

Merging all pairs of a rank at once gives the library's result only if a merged symbol never
makes a pair that comes first itself. Pieces for which it can (another piece contains them and
has a better or equal score) are merged one at a time, the leftmost of the word first.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from tarnseek.llm.arrow_groups import by_bytes
from tarnseek.llm.wordstore import WordStore, worker_store

MARK = "▁"
#: Characters encoded together.
_CHUNK = 1 << 20
#: Bytes of texts taken from a batch at once.
_BATCH_BYTES = 1 << 20
#: A word of more symbols than this takes its merges from a heap: the same merges, without a round for each.
_LONG_WORD = 2_000
_NEVER = np.iinfo(np.int32).max


@dataclass
class MergeTable:
    """What encoding needs of a model, as arrays."""

    codepoint: np.ndarray  # symbol of each code point, or -1 - code point for one the model lacks
    pair: np.ndarray  # sorted: left symbol * symbols + right symbol
    rank: np.ndarray  # of each pair; pieces of one score share it
    merged: np.ndarray  # the symbol a pair becomes
    alone: np.ndarray  # pair merged one at a time
    symbols: int
    pieces: int  # symbols from here on are characters that aren't pieces themselves
    byte_ids: np.ndarray
    extra: list[str]  # the characters of those symbols
    begin: int
    end: int


_NORMAL, _UNUSED, _USER, _BYTE = 1, 5, 4, 6


def merge_table(model: bytes) -> MergeTable:
    """Read a model. Raises ValueError for those that aren't plain BPE with byte fallback."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    trained, normal = proto.trainer_spec, proto.normalizer_spec
    if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("the model must be BPE with byte fallback and white space before words")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix:
        raise ValueError("the model must leave texts as they are but for one space before them")
    if any(p.type in (_UNUSED, _USER) for p in proto.pieces):
        raise ValueError("the model has user-defined or unused pieces")
    score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
    if any(MARK in p.lstrip(MARK) for p in score):
        raise ValueError("the model has pieces that go on over a space")
    symbol = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    extra = sorted({c for p in score for c in p} - set(symbol))
    for c in extra:
        symbol[c] = len(proto.pieces) + extra.index(c)
    ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    found, early = [], set()
    for piece, s in score.items():
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in symbol and right in symbol:
                found.append((symbol[left], symbol[right], ranks[s], symbol[piece]))
                early |= {symbol[x] for x in (left, right) if len(x) > 1 and score[x] <= s}
    size = len(proto.pieces) + len(extra)
    left, right, rank, merged = np.array(found, np.int64).reshape(-1, 4).T
    order = np.argsort(left * size + right)
    codepoint = -1 - np.arange(0x110000, dtype=np.int32)
    for c, i in symbol.items():
        if len(c) == 1:
            codepoint[ord(c)] = i
    byte_ids = np.array([i for i, p in enumerate(proto.pieces) if p.type == _BYTE], np.int32)
    return MergeTable(
        codepoint, (left * size + right)[order], rank[order].astype(np.int32), merged[order].astype(np.int32),
        np.isin(merged[order], list(early)), size, len(proto.pieces), byte_ids, extra, trained.bos_id, trained.eos_id,
    )


def _pairs(table: MergeTable, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where each pair stands in the table, or -1."""
    key = left.astype(np.int64) * table.symbols + right
    at = np.minimum(np.searchsorted(table.pair, key), len(table.pair) - 1)
    return np.where((table.pair[at] == key) & (left >= 0) & (right >= 0), at, -1)


def merge_words(table: MergeTable, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has. Words are non-empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sym, word = table.codepoint[points], np.repeat(np.arange(len(words)), sizes)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.flatnonzero(sizes > _LONG_WORD):
        end = int(sizes[: w + 1].sum())
        merged = _merge_by_heap(table, sym[end - sizes[w] : end].tolist())
        done.append((np.array(merged, np.int32), np.full(len(merged), w)))
    short = (sizes <= _LONG_WORD)[word]
    sym, word = sym[short], word[short]
    pair = np.full(len(sym), -1)
    inside = np.flatnonzero(word[:-1] == word[1:])
    pair[inside] = _pairs(table, sym[inside], sym[inside + 1])
    while len(sym):
        rank = np.where(pair >= 0, table.rank[pair], _NEVER)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(first, len(word)))
        least = np.minimum.reduceat(rank, first)
        over = np.repeat(least == _NEVER, size)
        if over.any():
            done.append((sym[over], word[over]))
            going = ~over
            sym, word, pair, rank = sym[going], word[going], pair[going], rank[going]
            least, size = least[least != _NEVER], size[least != _NEVER]
            if not len(sym):
                break
        index = np.arange(len(sym))
        best = rank == np.repeat(least, size)
        # Of pairs that overlap take every other one, from the left.
        starts = best & ~np.concatenate(([False], best[:-1]))
        run = np.maximum.accumulate(np.where(starts, index, 0))
        take = best & ((index - run) % 2 == 0)
        single = take & table.alone[pair]
        if single.any():
            words_first = np.cumsum(size) - size
            leftmost = np.minimum.reduceat(np.where(take, index, len(sym)), words_first)
            only = np.repeat(np.logical_or.reduceat(single, words_first), size)
            take &= ~only | (index == np.repeat(leftmost, size))
        at = np.flatnonzero(take)
        sym[at] = table.merged[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1
        sym, word, pair = sym[keep], word[keep], pair[keep]
        touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
        pair[touched] = -1
        touched = touched[touched + 1 < len(sym)]
        touched = touched[word[touched] == word[touched + 1]]
        pair[touched] = _pairs(table, sym[touched], sym[touched + 1])
    sym = np.concatenate([s for s, _ in done])
    word = np.concatenate([w for _, w in done])
    order = np.argsort(word, kind="stable")
    sym, word = _as_ids(table, sym[order], word[order])
    return sym, np.bincount(word, minlength=len(words))


def _merge_by_heap(table: MergeTable, sym: list[int]) -> list[int]:
    """The merges of one long word, the best pair first and of equal ones the leftmost."""
    left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym))) + [-1]
    pairs = _pairs(table, np.array(sym[:-1]), np.array(sym[1:]))
    heap = [(int(table.rank[p]), i, sym[i], sym[i + 1], int(table.merged[p])) for i, p in enumerate(pairs) if p >= 0]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def push(i: int) -> None:
        j = right[i]
        if j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        p = known.get((sym[i], sym[j]))
        if p is None:
            p = known[sym[i], sym[j]] = int(_pairs(table, np.array([sym[i]]), np.array([sym[j]]))[0])
        if p >= 0:
            heapq.heappush(heap, (int(table.rank[p]), i, sym[i], sym[j], int(table.merged[p])))

    gone = [False] * len(sym)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = right[i]
        if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
            continue
        sym[i], gone[j], right[i] = merged, True, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [s for s, g in zip(sym, gone) if not g]


def _as_ids(table: MergeTable, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that the model lacks become the ids of their UTF-8 bytes."""
    odd = np.flatnonzero((sym < 0) | (sym >= table.pieces))
    if not len(odd):
        return sym, word
    chars = [chr(-1 - s) if s < 0 else table.extra[s - table.pieces] for s in sym[odd].tolist()]
    encoded = [c.encode("utf-8", "surrogatepass") for c in chars]
    count = np.ones(len(sym), np.int64)
    count[odd] = list(map(len, encoded))
    out = np.repeat(sym, count)
    at = np.repeat(np.isin(np.arange(len(sym)), odd), count)
    out[at] = table.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
    return out, np.repeat(word, count)


def _new_words(table: MergeTable):
    """Ids of words as ``words_of`` gives them."""
    return lambda words: merge_words(table, [MARK + w.replace(" ", MARK) for w in words])


def word_store(table: MergeTable) -> WordStore:
    return WordStore(_new_words(table))


def words_of(text: str) -> list[str]:
    """The text cut before each space that follows another character; the space itself is left out.

    Further spaces before a word stay with it. No text, no words.
    """
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for w in words[:-1]:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return out + [" " * spaces + words[-1]]


def _parts(text: str, size: int = _CHUNK) -> Iterator[str]:
    """Long texts in parts that can be encoded on their own: cut at a space after another character."""
    text = text.replace(MARK, " ")
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1] == " ":
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def encode_texts(table: MergeTable, store: WordStore, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text with begin and end ids."""
    begin, end = np.array([table.begin], np.int32), np.array([table.end], np.int32)
    out: list[np.ndarray] = []
    waiting: list[list[str]] = []
    held = 0

    def flush() -> None:
        nonlocal waiting, held
        flat, size = store.ids([w for words in waiting for w in words])
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([len(w) for w in waiting])] if waiting else []
        at = 0
        for e in ends:
            out.append(np.concatenate((begin, flat[at:e], end)))
            at = e
        waiting, held = [], 0

    for text in texts:
        if len(text) > _CHUNK:
            flush()
            out.append(np.concatenate([begin, *(store.ids(words_of(p))[0] for p in _parts(text)), end]))
            continue
        waiting.append(words_of(text))
        held += len(text)
        if held > _CHUNK:
            flush()
    flush()
    return out


def _read(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def _encoder(docs: DataFrame, model: bytes):
    """A function of the worker: the ids of some texts (an Arrow array), as a list of arrays."""
    key = "sentencepiece " + hashlib.sha256(model).hexdigest()
    table = docs.sparkSession.sparkContext.broadcast(merge_table(model))

    def ids_of(texts: pa.Array) -> list[np.ndarray]:
        store = worker_store(key, lambda: _new_words(table.value))
        return encode_texts(table.value, store, [t or "" for t in texts.to_pylist()])

    return ids_of


def _binary(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every row: the ids with begin and end, as little-endian unsigned 32-bit integers.

    The ids are those the sentencepiece library gives for the whole text. Null and empty texts
    have the begin and end ids only. Repeated rows and ids of any size or null stay as they are; other columns aren't read.
    The model is read by the driver and sent along.
    """
    ids_of = _encoder(docs, _read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in by_bytes(batch, "text", _BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _binary(ids_of(rows.column("text")))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the decoded ``text``. Null ids count as none."""
    model = _read(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for rows in by_bytes(batch, "ids", 4 * _BATCH_BYTES):
                texts = [processor.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text`` as ``decode`` of ``encode`` gives them, by one Python worker a core instead of two."""
    model = _read(model_path)
    ids_of = _encoder(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for rows in by_bytes(batch, "text", _BATCH_BYTES):
                ids = ids_of(rows.column("text"))
                texts = pa.array([processor.decode(i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _binary(ids), texts], names=["doc_id", "ids", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, text string")
