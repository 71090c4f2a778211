"""Record sources: rows of ``(_name, _key, value)``.

``_name`` is the list or hash a record belongs to, ``_key`` its place in the
list or its key in the hash, ``value`` its JSON text. Batch and streaming reads
share the schema. A list streams files as they arrive, a hash the keys after the last
one taken; the checkpoint is the resume point of both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tarnseek.errors import TarnseekError
from tarnseek.operators.ordering import SortKey, page_rows
from tarnseek.schema import RecordSource
from tarnseek.sources.hash_feed import FORMAT, HashSource

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("_name", T.StringType()),
        T.StructField("_key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
FILES_PER_BATCH = 1_000
#: A hundred years: as good as no limit.
FILE_AGE = "36500d"
ARRIVED = "_arrived"


def name_matches(pattern: str, name: Column | None = None) -> Column:
    """A plain name selects one source; ``abc*`` all whose names start with ``abc``."""
    name = F.col("_name") if name is None else name
    if "*" in pattern:
        return name.startswith(pattern.replace("*", ""))
    return name == pattern


#: Characters that Spark spells as %XX in the names of partition folders. Fixed values.
_ESCAPED = re.compile(r"""["#%'*/:=?\\{\[\]^\x00-\x1f\x7f]""")


def _folders(source: RecordSource) -> str:
    """The folders of the matching names, as a glob: the stream takes a plain path for a table of its own."""
    start = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", source.name.replace("*", ""))
    return f"{source.path.rstrip('/')}/[_]name={start}{'*' if '*' in source.name else ''}"


def read_records(spark: SparkSession, source: RecordSource) -> DataFrame:
    """All records of the source. Where each name has its folder, only those of matching names are read."""
    df = spark.read.schema(RECORD_SCHEMA).format(source.format).load(source.path)
    return df.where(name_matches(source.name)).select(*RECORD_SCHEMA.names)


def current_records(spark: SparkSession, source: RecordSource) -> DataFrame:
    """All records of the source with the time of their files, by which newer ones of a key are told from older."""
    df = spark.read.schema(RECORD_SCHEMA).format(source.format).load(source.path).where(name_matches(source.name))
    return df.select(*RECORD_SCHEMA.names, F.col("_metadata.file_modification_time").alias(ARRIVED))


def stream_records(
    spark: SparkSession, source: RecordSource, files_per_batch: int = FILES_PER_BATCH, file_age: str = FILE_AGE
) -> DataFrame:
    """Records of the source as a stream.

    A list gives new files, the oldest first, at most ``files_per_batch`` at a time, and ``_arrived``, the time of the file. Names are
    looked for anew in each batch, and where each name has its folder, only matching ones are listed. Files whose time
    is further than ``file_age`` behind the newest are skipped for good; by default none is, at the cost of remembering each.
    A hash gives all pairs after the last keys (see ``hash_feed``).
    """
    if source.kind == "hash":
        spark.dataSource.register(HashSource)
        return spark.readStream.format(FORMAT).option("name", source.name).load(source.path)
    reader = spark.readStream.schema(RECORD_SCHEMA).format(source.format)
    reader = reader.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", file_age)
    path = source.path
    if source.by_name:
        reader, path = reader.option("basePath", source.path), _folders(source)
    df = reader.load(path).where(name_matches(source.name))
    return df.select(*RECORD_SCHEMA.names, F.col("_metadata.file_modification_time").alias(ARRIVED))


def list_range(records: DataFrame, name: str, offset: int, count: int) -> DataFrame:
    """Elements ``offset`` … ``offset + count - 1`` of a list.

    The key is the position, so this is a range filter: nothing is sorted.
    """
    if offset < 0 or count < 1:
        raise TarnseekError(f"bad list range ({offset}, {count})")
    position = F.col("_key").try_cast("long")
    return records.where(name_matches(name) & position.between(offset, offset + count - 1))


def hash_range(records: DataFrame, name: str, after: str, count: int) -> DataFrame:
    """The next ``count`` pairs of a hash with keys greater than ``after``, in key order."""
    if count < 1:
        raise TarnseekError(f"bad hash range size ({count})")
    pairs = records.where(name_matches(name) & (F.col("_key") > after))
    return page_rows(pairs, [SortKey(F.col("_key"))], 1, count)


def to_records(df: DataFrame, name: Column, key: Column, *columns: str) -> DataFrame:
    """Turn a typed table into records with JSON values; missing columns are left out."""
    value = F.to_json(
        F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    )
    return df.select(name.cast("string").alias("_name"), key.cast("string").alias("_key"), value.alias("value"))
