"""What the training-data operators share: words, shared storage, row packing and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
NOT_WORD = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of this machine, if all runs on this machine; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder. It cuts lineage, survives lost executors and has a known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing holds any more, instead of when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Keys that more than one in HOT of all rows have are split to SPLIT parts; there are fewer than HOT of them, whatever the data.
HOT, SPLIT = 512, 64


def split_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, by: str) -> DataFrame:
    """left joined with right on the number `key`, of which right has few rows each; counts (key, c) tells how many rows of left have a key, and `by` deals those of hot keys."""
    total, most = counts.agg(F.sum("c"), F.max(F.expr("if(c > 1000, c, null)"))).first()
    if not most or most * HOT <= total:
        return left.join(right, key)
    hot = ", ".join(f"{r[0]}L" for r in counts.where(f"c > 1000 and c * {HOT} > {total}").select(key).collect())
    dealt = left.withColumn("salt", F.expr(f"if({key} in ({hot}), pmod(xxhash64({by}), {SPLIT}), 0L)"))
    copied = right.withColumn("salt", F.explode(F.expr(f"if({key} in ({hot}), sequence(0L, {SPLIT - 1}L), array(0L))")))
    return dealt.join(copied, [key, "salt"]).drop("salt")


class Sieve:
    """Which 64-bit hashes may be in a table: two bits for each, at the place of its first bits and at that of its last, of at most 2**28 bits (32 MiB). It never holds one back that is in the table."""

    def __init__(self, hashes: DataFrame, column: str, per: int = 32, most: int = 28):
        self.bits = min(max(10, (hashes.count() * per).bit_length()), most)
        # At most 2**22 numbers reach the driver.
        ends = f"explode(array(shiftrightunsigned({column}, {64 - self.bits}), {column} & {2**self.bits - 1}L)) as x"
        place = hashes.selectExpr(ends).selectExpr("x div 64 as i", "shiftleft(1L, int(x % 64)) as b").groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
        self.held = np.zeros(2**self.bits // 64, dtype=np.uint64)
        self.held[place["i"].to_numpy()] = place["b"].to_numpy().view(np.uint64)

    def may(self, g: np.ndarray) -> np.ndarray:
        found = np.ones(len(g), dtype=bool)
        for place in (g >> np.uint64(64 - self.bits), g & np.uint64(2**self.bits - 1)):
            found &= (self.held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD + "+"), "")


def let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` standing for `value`, which is worked out once even where body uses it inside a lambda."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running_sums(sizes: str, block: int = 64) -> str:
    """SQL for the sums of all elements before each one of the array expression `sizes` of whole numbers.

    Blocks are added up first, once, so an array of n elements takes n * block / 2 + (n / block) ** 2 additions at most.
    """
    starts = f"aggregate(run_x, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + aggregate(x, 0L, (c, y) -> c + y))))"
    within = "transform(run_b.x, (run_y, run_i) -> run_b.s + aggregate(slice(run_b.x, 1, run_i), 0L, (c, y) -> c + y))"
    cut = f"transform(sequence(0, (size(run_n) - 1) div {block}), b -> slice(run_n, b * {block} + 1, {block}))"
    return let(sizes, "run_n", f"if(size(run_n) = 0, cast(array() as array<bigint>), {let(cut, 'run_x', let(starts, 'run_s', f'flatten(transform(run_x, (x, i) -> {let("named_struct('x', x, 's', get(run_s, i))", 'run_b', within)}))'))})")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps, each one shuffle on a node with stored results, until nothing changes;
    the number of rounds is logarithmic and no component is ever gathered in one task.
    """
    live = stored(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}-edges")
    print_ = _print(live)
    while True:
        both = live.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(live.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(low, "hi")
        small = linked.select("hi", F.col("m").alias("lo")).unionAll(linked.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        after = stored(small, f"{name}-edges")
        discard(live)
        live, before, print_ = after, print_, _print(after)
        if before == print_:
            return live.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(live.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of an edge list: two numbers, whatever its length."""
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum((h % 1_000_003).cast("long"))).first())
