"""Shared pieces of the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cases A-Z and leaves every other byte.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(value) -> bytes:
    """UTF-8 bytes of a text; a null text has none."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a new one and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="guildspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    Lost executors then cost a reread, and expensive Python stages run once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/guildspark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, keep: dict[str, Column], out, per_batch: Callable, per_bytes: int = 8 << 20) -> DataFrame:
    """Runs per_batch(pa.RecordBatch) -> pa.RecordBatch over the selected columns in slices of about per_bytes.

    keep names the input columns, so extra or clashing columns of df never reach the function."""
    selected = df.select(*[c.alias(n) for n, c in keep.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, per_bytes):
                with no_gc():
                    out = per_batch(part)
                yield out

    return selected.mapInArrow(run, out)


_held: dict = {}


def held(key, build: Callable):
    """A worker's model of `key`, made by build(). A worker holds one: the models and memories of other operators, whose
    stages ran in it before, are dropped, so a pipeline needs no more memory than its greediest stage."""
    if _held.get("key") != key:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held.update(key=key, model=build())
    return _held["model"]


@contextlib.contextmanager
def no_gc():
    """Without the search for cycles, which costs much where many objects are made and none refer to each other."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batch, per_bytes: int) -> Iterable:
    """Cuts a batch into runs of rows of about per_bytes, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(n, n * per_bytes // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


class Memory:
    """A bounded memory of values by key: keys that were used lately stay.

    There are two generations; a key that is used moves to the younger one, and when that is full the
    older one is forgotten. A value is never None."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.young, self.old = limit, {}, {}

    def values(self, keys: list, make: Callable[[list], list]) -> list:
        """The value of each key; make(keys) gives those of the unknown ones."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        unknown = []
        for i in [i for i, v in enumerate(out) if v is None]:
            if (v := old.get(keys[i])) is None:
                unknown.append(i)
            else:
                out[i] = young[keys[i]] = v
        for i, v in zip(unknown, make([keys[i] for i in unknown]) if unknown else (), strict=True):
            out[i] = young[keys[i]] = v
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return out


def split_on_spaces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What stands between the single spaces of each text, as one dictionary array, and where each text begins in it.

    A null or empty text has one empty word."""
    lists = pc.split_pattern(texts.fill_null(""), pattern=" ")
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()


def gather(values: list[bytes] | pa.Array, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """values[places[0]], values[places[1]], ... in one piece, and the end of each."""
    taken = (values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())).take(pa.array(places))
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[taken.offset + 1 : taken.offset + 1 + len(taken)]
    return (data.to_pybytes()[: int(ends[-1])] if data is not None and len(ends) else b""), ends


def used(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n entries are used, ascending, and each place's rank among them."""
    seen = np.zeros(n, bool)
    seen[places] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[places]


def any_in(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a flag is set in each run from starts[i] up to starts[i + 1]."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[starts]) > 0


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., and each column's new name: Arrow functions take no names with dots."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, salt: Column, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row per key and in n the number of rows that have it; n is left out.

    A key with more than a partition's share of the `total` rows is dealt over several tasks: its rows are spread by
    `salt` and its row of keyed is copied as often. Such keys are fewer than the partitions, so they are broadcast."""
    share = max(1, total // partitions(rows.sparkSession))
    copies, lane = fresh(rows, "copies"), fresh(rows, "lane")
    hot = keyed.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("int").alias(copies))
    spread = rows.join(F.broadcast(hot), on, "left").withColumn(lane, F.when(F.col(copies).isNull(), 0).otherwise(F.pmod(salt, F.col(copies)).cast("int"))).drop(copies)
    copied = keyed.withColumn(lane, F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int") - 1).otherwise(0))))
    return spread.join(copied.drop("n"), [*on, lane], how).drop(lane)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


__all__ = ["ASCII_LOWER", "F", "Memory", "T", "any_in", "cut", "fresh", "gather", "held", "join_counted", "map_texts", "no_gc", "numbered", "partitions", "read", "record_batch", "shared_dir", "slices", "split_on_spaces", "used", "utf8"]
