"""Helpers shared by the training-data operators: staged tables, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of a membership filter at most: 32 MB are broadcast. Beyond about 30 million keys it lets more rows through.
FILTER_BITS = 1 << 28
#: Bytes of the record batches that go to Python workers.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


#: Paths of this process's staged tables that are not dropped yet.
_written: list[str] = []


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing will read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


def written() -> frozenset[str]:
    """The staged tables that are not dropped yet."""
    return frozenset(_written)


def drop_staged(spark: SparkSession, before: frozenset[str] = frozenset(), *keep: DataFrame) -> None:
    """Delete all staged tables but those that were there before and those that `keep` read."""
    kept = before | {getattr(k, "staged_at", "") for k in keep}
    drop(spark, *[p for p in _written if p not in kept])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


class Membership:
    """A test of longs: true for every key of a one-column table of longs, and for few other values.

    A Bloom filter of at most `most_bits` bits, so what is broadcast is bounded; with more keys than that is
    good for, more values pass and none is lost: callers go on exactly with what passes.
    """

    def __init__(self, keys: DataFrame, most_bits: int = FILTER_BITS):
        key = keys.columns[0]
        n, self.bits = keys.count(), 1 << 10
        while self.bits < min(most_bits, 10 * n):
            self.bits *= 2
        bit = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*self.places(F.col(key)))).alias("bit"))
        word = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits")).toArrow()
        table = np.zeros(self.bits // 64, np.int64)
        table[word.column("word").to_numpy()] = word.column("bits").to_numpy()
        self.shared = keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def places(self, c: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), c), F.lit(self.bits)) for i in range(3)]

    def test(self) -> Callable[..., np.ndarray]:
        """A function of the arrays of places, for use in a task."""
        shared = self.shared

        def passes(*places: pa.Array) -> np.ndarray:
            hit = np.ones(len(places[0]), bool)
            for x in places:
                at = x.to_numpy(zero_copy_only=False).astype(np.int64)
                hit &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            return hit

        return passes

    def __call__(self, c: Column) -> Column:
        test = self.test()

        @F.arrow_udf(BooleanType())
        def passes(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return pa.array(test(a, b, c))

        return passes(*self.places(c))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores (a small file) is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def short_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """From now on the session's record batches end at `most` bytes (a single larger row is one), not only at 10,000
    rows: batches of long texts take tens of MB on both sides of each Python worker. A smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < now <= most:
        spark.conf.set(key, most)


def by_batch(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], dict], limit: int = 8 << 20) -> DataFrame:
    """mapInArrow with a function from a record batch to {column: values}, in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in chunks(batch, limit):
                yield pa.RecordBatch.from_pydict(each(small), schema=arrow)

    arrow = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose bytes are near limit at most; a single larger row is a slice."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, component), component < node.

    Alternating large-star and small-star rounds; every round is written to the shared folder.
    The result has no row for the smallest node of a component. Null ends and loops are ignored.
    The rounds only group and join on node ids: hubs are pre-aggregated by min() and adaptive
    execution splits their join partitions.
    """
    pairs = staged(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        # large-star: every larger neighbour of u moves to the smallest neighbour of u
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is the smallest of its neighbours keeps them; links to larger roots go
        large = large.where("u != v").distinct()
        # small-star: smaller neighbours of u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, pairs = pairs, staged(small, "stars")
        drop(pairs.sparkSession, before.staged_at)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
