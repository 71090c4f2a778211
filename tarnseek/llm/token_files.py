"""Token ids in binary files: Simple-8b blocks, in ascending order of documents, with an index.

A file is: 8 bytes magic, the packed words, the word at which each block starts (unsigned 64 bits
each), and a footer of three unsigned 64-bit numbers: ids, blocks, ids per block. All numbers are
little-endian. The index is a table with a row per document; ids of a document go on over blocks.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnseek.llm import simple8b
from tarnseek.llm.arrow_groups import by_bytes
from tarnseek.llm.common import row_key, shared_uri, text_of, written
from tarnseek.llm.wordstore import worker_store

MAGIC = b"TNS8B\x00\x00\x01"
_FOOTER = 24
#: Bytes of texts tokenized together, blocks packed together, and blocks read together.
_CHUNK = 1 << 21
_PACKED_BLOCKS = 256
_READ_BLOCKS = 512
_DOUBLE_SPACE = re.compile(r" \s|\s ")
_ASCII_PAIRS = ["  ", *[p for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f" for p in (" " + c, c + " ")]]


#: Marks the word at a text's beginning, which has no space before it. No text holds it.
FIRST = "\ud800"
#: Of texts in these characters the words are known: letters that have been so in all versions of Unicode tables, and ASCII.
_KNOWN = re.compile("[\x00-\x7FÀ-ÖØ-öø-ɏ]*")
#: How the tokenizer cuts such texts (fixed values): contractions, letters, digits, other marks, white space.
_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^ \t-\rA-Za-zÀ-ÖØ-öø-ɏ0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)
_STORED_BYTES = 176 << 20


def chunks_of(text: str) -> list[str]:
    """The text cut before each space that stands between two characters that aren't white space.

    The tokenizer always starts a new word there, so the chunks can be encoded on their own. A chunk is given
    without the space before it; one at the beginning of the text, which has none, is marked by FIRST.
    """
    parts = text.split(" ")
    if any(p in text for p in _ASCII_PAIRS) if text.isascii() else _DOUBLE_SPACE.search(text):
        words = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace() and words[-1] and not words[-1][-1].isspace():
                words.append(p)
            else:
                words[-1] += " " + p
        parts = words
    elif len(parts) > 1 and not parts[-1]:
        parts[-2:] = [parts[-2] + " "]
    if parts[0]:
        parts[0] = FIRST + parts[0]
        return parts
    return parts[1:]


def spelt(chunk: str) -> str:
    """The text of a chunk."""
    return chunk[1:] if chunk.startswith(FIRST) else " " + chunk


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary spells each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _new_words(tokenizer, special: tuple[str, ...] = ()):
    """Ids of chunks by the tokenizers library.

    Chunks in known letters are cut into words here and go to the library's model; the others, and those that
    hold a special token, are cut by the library too.
    """
    tokenize, letters, marks = tokenizer.model.tokenize, _byte_letters(), {}
    space, plain = letters[ord(" ")], not any(t.isalpha() for t in special)

    def of(piece: str) -> list[int]:
        if piece in marks:
            return marks[piece]
        as_bytes = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = [t.id for t in tokenize(as_bytes.translate(letters))]
        if len(piece) == 1:
            marks[piece] = ids
        return ids

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = []
        rest = []
        for i, c in enumerate(chunks):
            if plain and c.isascii() and c.isalpha():
                found.append([t.id for t in tokenize(space + c)])
            else:
                rest.append(i)
                found.append([])
        texts = [spelt(chunks[i]) for i in rest]
        whole = "\n".join(texts)
        held = [t for t in special if t in whole]
        odd = []
        for i, text in zip(rest, texts):
            if _KNOWN.fullmatch(text) and not any(t in text for t in held):
                for w in _WORD.findall(text):
                    found[i] += of(w)
            else:
                odd.append(i)
        if odd:
            by_library = tokenizer.encode([spelt(chunks[i]) for i in odd], is_pretokenized=True, add_special_tokens=False)
            for word, x in zip(by_library.word_ids, by_library.ids):
                found[odd[word]].append(x)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    return encode


class _Writer:
    """One file, written block after block."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.starts: list[np.ndarray] = []
        self.words = self.ids = 0
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= _PACKED_BLOCKS * simple8b.BLOCK:
            self._flush(self.held // simple8b.BLOCK * simple8b.BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int32)
        words, starts = simple8b.pack(ids[:count].astype(np.uint64))
        self.out.write(words.astype("<u8").tobytes())
        self.starts.append(starts + self.words)
        self.words += len(words)
        self.ids += count
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self._flush(self.held)
        starts = np.concatenate(self.starts)
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(np.array([self.ids, len(starts), simple8b.BLOCK], "<u8").tobytes())
        self.out.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Tokenize, write the files, and return their index: doc_id, file, part, first (in the file), n_tokens.

    ``end_id`` ends each document. Ids are those of the tokenizers library for the whole text, without
    special tokens added; strings of special tokens within a text are read as the library does by default.
    Documents lie in ascending order of doc_id, nulls first; rows of one id in order of their text's hash.
    A null text counts as empty and has the end id only. Other columns aren't read. An empty table has no files.

    Each task writes a file of its own name; files of attempts that failed aren't in the index.
    ``folder`` is any place that all executors reach.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    special = tuple(t["content"] for t in json.loads(vocabulary).get("added_tokens", []))
    if any(c.isspace() for t in special for c in t):
        raise ValueError("special tokens with white space would lie across words")
    key = "tokenizers " + hashlib.sha256(vocabulary.encode()).hexdigest()
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary)
    folder = folder or shared_uri(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words and ids are many small objects without cycles; looking for cycles among them takes long.
        gc.disable()
        try:
            yield from write(batches)
        finally:
            gc.enable()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        store = worker_store(key, lambda: _new_words(Tokenizer.from_str(vocabulary.value), special), _STORED_BYTES)
        end = np.array([end_id], np.int32)
        writer, part = None, TaskContext.get().partitionId()
        uri = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.s8b"
        for batch in batches:
            for rows in by_bytes(batch, "text", _CHUNK):
                first, counts = [], []
                words = [chunks_of(t) for t in rows.column("text").to_pylist()]
                flat, size = store.ids([w for ws in words for w in ws])
                ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([len(w) for w in words])]
                writer = writer or _Writer(uri)
                at = 0
                for e in ends:
                    first.append(writer.ids + writer.held)
                    counts.append(int(e) - at + 1)
                    writer.add(flat[at:e])
                    writer.add(end)
                    at = int(e)
                n = rows.num_rows
                columns = [rows.column("doc_id"), pa.array([uri] * n), pa.array([part] * n, pa.int32()), pa.array(first, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "part", "first", "n_tokens"])
        if writer:
            writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"), row_key().alias("row_key"))
    rows = rows.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    index = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, file string, part int, first long, n_tokens long")
    return written(index, "token-index")


class TokenFile:
    """Reads ranges of ids; blocks that follow each other are read at once."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        self.ids, blocks, self.block = np.frombuffer(self.file.read_at(_FOOTER, size - _FOOTER), "<u8").astype(np.int64).tolist()
        self.end = size - _FOOTER - 8 * blocks
        starts = np.frombuffer(self.file.read_at(8 * blocks, self.end), "<u8").astype(np.int64)
        self.starts = np.append(starts, (self.end - len(MAGIC)) // 8)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last, the last one included."""
        low, high = int(self.starts[first]), int(self.starts[last + 1])
        words = np.frombuffer(self.file.read_at(8 * (high - low), len(MAGIC) + 8 * low), "<u8")
        counts = np.minimum(self.ids - np.arange(first, last + 1) * self.block, self.block)
        return simple8b.unpack(words, self.starts[first : last + 1] - low, counts)

    def close(self) -> None:
        self.file.close()


def _ranges(uri: str, firsts: list[int], counts: list[int]) -> Iterator[np.ndarray]:
    """The ids of each (first, count) of one file, in ascending order."""
    file = TokenFile(uri)
    held, base, upto = np.zeros(0, np.uint64), 0, 0
    for first, count in zip(firsts, counts):
        out = []
        at, end = first, first + count
        while at < end:
            if not base <= at < upto:
                block = at // file.block
                last = min(block + _READ_BLOCKS, -(-file.ids // file.block)) - 1
                held, base = file.blocks(block, last), block * file.block
                upto = base + len(held)
            out.append(held[at - base : end - base])
            at = min(end, upto)
        yield np.concatenate(out) if len(out) != 1 else out[0]
    file.close()


def read_tokens(index: DataFrame) -> DataFrame:
    """``index`` with the ids read back from the files: ``ids``, little-endian unsigned 32-bit integers."""
    names = ["doc_id", "file", "part", "first", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                firsts, counts = piece.column("first").to_pylist(), piece.column("n_tokens").to_pylist()
                start = 0
                for uri, same in groupby(piece.column("file").to_pylist()):
                    stop = start + sum(1 for _ in same)
                    ids = [i.astype("<u4").tobytes() for i in _ranges(uri, firsts[start:stop], counts[start:stop])]
                    columns = piece.slice(start, stop - start).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"])
                    start = stop

    kind = index.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, file string, part int, first long, n_tokens long, ids binary"
    # The index is read in the order in which it was written, which is that of the files.
    return index.select(names).mapInArrow(run, schema)


def document_starts(index: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of the index, with ``start``: the ids of all documents before. One number per file comes to the driver."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in totals:
        starts.append((r["part"], before))
        before += r["n"]
    offsets = index.sparkSession.createDataFrame(starts, "part int, before long")
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")
