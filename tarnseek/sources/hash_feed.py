"""Hashes as a stream: pairs with keys after the last one taken, for each hash.

The feed is a folder of Parquet files with columns ``_key`` and ``value``, and ``_name`` as a column or, better, as
the folders ``_name=…`` that Spark writes with ``partitionBy("_name")``: then only the folders of matching names are looked into.

The offset is the last key of each hash. A batch takes, for all matching hashes, the pairs whose keys come
after it (in code-point order) up to the greatest key there is; names are looked for anew in each batch. The greatest keys
come from the files' footers, each read once, so planning reads no rows. A pair put later under a key that isn't after the
last one taken isn't seen: that is how a scan of a hash by key goes on. Use a list for records that arrive in any order.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "tarnseek_hash"
_SCHEMA = "_name string, _key string, value string"
_FOLDER = re.compile(r"(?:^|/)_name=([^/]*)/")

# Executors get the reader by value and don't need the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def is_wanted(pattern: str, name: str | None) -> bool:
    """As ``name_matches`` does for a column."""
    if name is None:
        return False
    return name.startswith(pattern.replace("*", "")) if "*" in pattern else name == pattern


class HashFiles:
    """The files of a feed, each with its row groups: (name, least key, greatest key) of what they hold."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.known: dict[tuple, list[tuple[int, dict[str, tuple[str, str]]]]] = {}

    def _listed(self, folder: str) -> list[pafs.FileInfo]:
        return self.fs.get_file_info(pafs.FileSelector(folder, recursive=False, allow_not_found=True))

    def paths(self) -> list[tuple[str, str | None, tuple]]:
        """(path, name if the folder says it, what tells its content) of the files in matching folders, at any depth."""
        found, waiting = [], [(self.root, None)]
        while waiting:
            folder, name = waiting.pop()
            for info in self._listed(folder):
                if info.base_name.startswith((".", "_")) and not info.base_name.startswith("_name="):
                    continue
                if info.type == pafs.FileType.Directory:
                    here = unquote(info.base_name[6:]) if info.base_name.startswith("_name=") else name
                    if here is None or is_wanted(self.pattern, here):
                        waiting.append((info.path, here))
                elif info.size:
                    found.append((info.path, name, (info.path, info.size, info.mtime_ns)))
        return found

    def groups(self, path: str, name: str | None, identity: tuple) -> list[tuple[int, dict[str, tuple[str, str]]]]:
        """(row group, {name: (least key, greatest key)}), for the wanted names. Read once for each file."""
        if identity not in self.known:
            file = pq.ParquetFile(self.fs.open_input_file(path))
            with file:
                self.known[identity] = [(g, ends) for g in range(file.num_row_groups) if (ends := self._ends(file, g, name))]
        return self.known[identity]

    def _ends(self, file: pq.ParquetFile, group: int, name: str | None) -> dict[str, tuple[str, str]]:
        meta = file.metadata.row_group(group)
        stats = {meta.column(i).path_in_schema: meta.column(i).statistics for i in range(meta.num_columns)}
        key = stats.get("_key")
        if name is None:
            names = stats.get("_name")
            if names is not None and names.has_min_max and names.min == names.max and names.null_count == 0:
                name = names.min
        if name is not None and key is not None and key.has_min_max:
            return {name: (key.min, key.max)} if is_wanted(self.pattern, name) else {}
        # Several names in one row group, or no figures in the footer: the two columns are read, a name at a time.
        rows = file.read_row_group(group, columns=["_key"] if name is not None else ["_name", "_key"])
        if name is not None:
            rows = rows.append_column("_name", pa.array([name] * rows.num_rows, pa.string()))
        ends = rows.filter(pc.is_valid(rows["_key"])).group_by("_name").aggregate([("_key", "min"), ("_key", "max")]).to_pylist()
        return {r["_name"]: (r["_key_min"], r["_key_max"]) for r in ends if is_wanted(self.pattern, r["_name"])}

    def last_keys(self) -> dict[str, str]:
        last: dict[str, str] = {}
        paths = self.paths()
        for path, name, identity in paths:
            for _, ends in self.groups(path, name, identity):
                for n, (_, high) in ends.items():
                    last[n] = max(high, last.get(n, high))
        gone = self.known.keys() - {identity for *_, identity in paths}
        for identity in gone:
            del self.known[identity]
        return last


class KeyRange(InputPartition):
    """A row group, and the keys to take of each hash in it: after the first, up to the second."""

    def __init__(self, path: str, group: int, name: str | None, keys: dict[str, tuple[str | None, str]]):
        self.path, self.group, self.name, self.keys = path, group, name, keys


class HashStream(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        self.files = HashFiles(path, pattern)

    def __getstate__(self):
        return self.path, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.last_keys()

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        out = []
        for path, name, identity in self.files.paths():
            for group, ends in self.files.groups(path, name, identity):
                keys = {}
                for n, (low, high) in ends.items():
                    after, upto = start.get(n), end.get(n)
                    if upto is not None and low <= upto and (after is None or high > after):
                        keys[n] = after, upto
                if keys:
                    out.append(KeyRange(path, group, name, keys))
        return out

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        with self.files.fs.open_input_file(partition.path) as source:
            columns = ["_key", "value"] if partition.name is not None else ["_name", "_key", "value"]
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.group], columns=columns):
                for name, (after, upto) in partition.keys.items():
                    keep = pc.less_equal(batch.column("_key"), upto)
                    if after is not None:
                        keep = pc.and_(keep, pc.greater(batch.column("_key"), after))
                    if partition.name is None:
                        keep = pc.and_kleene(keep, pc.equal(batch.column("_name"), name))
                    rows = batch.filter(keep)
                    if rows.num_rows:
                        names = pa.array([name] * rows.num_rows, pa.string())
                        yield pa.RecordBatch.from_arrays([names, rows.column("_key").cast(pa.string()), rows.column("value").cast(pa.string())], names=["_name", "_key", "value"])


class HashSource(DataSource):
    """``spark.readStream.format(FORMAT).option("path", …).option("name", …)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> HashStream:
        return HashStream(self.options["path"], self.options["name"])
