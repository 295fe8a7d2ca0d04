"""Helpers that the corpus operators share: names, row keys, bounded caches, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard, materialize, shared_dir  # noqa: F401  for the operators

#: White space that parts words: U+0020 and U+0009 to U+000D, which is also what bytes.split() parts by.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each behind as many underscores as make it differ from every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_key(id_col: str, text_col: str) -> F.Column:
    """What tells documents apart: the id and a hash of the text, as rows may share an id and differ in their texts."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))


class BoundedCache(dict):
    """A dict that computes what it lacks and stops growing at cap entries; keys over max_key are never kept."""

    def __init__(self, compute: Callable, cap: int = 400_000, max_key: int = 64):
        super().__init__()
        self.compute, self.cap, self.max_key = compute, cap, max_key

    def __missing__(self, key):
        value = self.compute(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> bool:
        """Whether there was room for the key."""
        if fine := len(self) < self.cap and len(key) <= self.max_key:
            self[key] = value
        return fine


def arrow_map(df: DataFrame, columns: list[str], fn: Callable[..., Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow over some columns; fn takes one list for each column of a batch and returns a dict of output lists."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            made = fn(*(b.column(i).to_pylist() for i in range(len(columns))))
            for part in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(col) -> F.Column:
    return F.crc32(col.cast("string").cast("binary"))
