"""What the corpus operators share: tables, the shared work folder, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of anything but space and \t \n \v \f \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: This process's folder of intermediate tables, under the shared folder.
RUN = uuid.uuid4().hex
_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only on one machine (a local master, as in tests) a temporary folder stands in for it if none is
    configured; on a cluster that is an error.
    """
    sc, given = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="barloom-"))
    return given or sc.getCheckpointDir()


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Lower the session's Arrow batches, if they are at Spark's default or above, to sizes that fit long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table lives as long as the driver's process, or until clear_work().
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/barloom/{RUN}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except (Py4JError, OSError):  # the JVM has ended before Python
        pass


def clear_work(spark: SparkSession) -> None:
    """Delete the tables that this process has left in the shared folder; call it when no result is still to be read."""
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/barloom/{RUN}")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small frames inside iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """The named input columns under internal names; other columns, whatever they are called, stay out."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as (a long, b long): (node, component = smallest node).

    Alternates large-star and small-star contraction (every node hooks its larger, then its
    smaller neighbours to the smallest one it sees), so rounds grow with the logarithm of the
    diameter. Each round is two min aggregates with map-side combine, each stored and then joined, so that adaptive
    execution can split the join's hot keys; no neighbour list is ever collected.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    e = checkpointed(e.distinct())
    state = None
    for _ in range(max_rounds):
        new = e.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if not new["n"]:
            break
        if state == (new["n"], new["s"]):
            # stable counts and sums: check that it is a star forest before stopping
            if e.select("a").groupBy("a").count().where("count > 1").isEmpty() and e.join(
                e.select(F.col("a").alias("b")), "b", "left_semi"
            ).isEmpty():
                break
        state = (new["n"], new["s"])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))  # apart from the join, which can then split a hub
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = checkpointed(large)
        low = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        e = checkpointed(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def sliced(batches, column: str, most: int = 4 << 20):
    """Cut record batches where the strings of a column pass about ``most`` characters; rows stay whole."""
    for batch in batches:
        col = batch.column(column)
        start = held = 0
        for i in range(batch.num_rows):
            held += len(s) if (s := col[i].as_py()) else 0
            if held >= most:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def typed(df: DataFrame, *without: str) -> list[str]:
    """Column definitions of df for a schema string."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without]


def runs(batches, keys: list[str]):
    """Consecutive rows with equal keys as one table each; input sorted by the keys, runs may span batches."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def link_summary(ids, weight, i, j):
    """For linked pairs (i, j) of rows: the summed weight of each row's partners, and the smallest id each row reaches."""
    import numpy as np

    n = len(ids)
    total = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            return total.astype(np.int64), root


def blocked(rows: DataFrame, keys: list[str], blocks: str, node: str) -> DataFrame:
    """Deal each group of rows over pairs of blocks (bi <= bj), so that every pair of rows meets in one of them.

    ``blocks`` is a column with the number of blocks of the row's group; a row's own block, blk,
    comes from a hash of ``node``. A group of g blocks costs each row g copies and no task more
    than two blocks. Rows come out sorted by keys, bi, bj within each partition.
    """
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(node, F.lit(7)), F.col(blocks)).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda k: k))
    rows = rows.withColumn("_o", other)
    rows = rows.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_o", blocks)
    by = [*keys, "bi", "bj"]
    return rows.repartition(*by).sortWithinPartitions(*by)


def ranked(rows: DataFrame, order: list, name: str, group: str | None = None) -> DataFrame:
    """rows with ``place`` (1, 2, 3...) in the given order within each group, and the group's ``total``, without a
    window over a whole group.

    Rows are dealt to ranges of (group, order) and stored; a range's first place is the sum of the
    sizes of the group's ranges before it (one row a range and group). Equal rows may part over
    ranges, by their number. A group of rows is a non-null column.
    """
    by = [group] if group else []
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = stored(numbered.repartitionByRange(*by, *order, "_row").withColumn("_range", F.spark_partition_id()), name)
    sizes = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = sizes.select("_range", *by, (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("total"))
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order, "_row"))
    placed = dealt.withColumn("_own", own).join(before if by else F.broadcast(before), ["_range", *by])  # without groups one row a partition
    return placed.withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range", "_row")


def once_a_task(df: DataFrame, *keys: str, most: int = 2_000_000) -> DataFrame:
    """df without the repeats of long keys that one task can see, so that a row repeated many times is shuffled
    once a task; what is left may still repeat over tasks (or after ``most`` keys in one)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        seen: set = set()
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            keep = np.zeros(len(rows), bool)
            for i, row in enumerate(rows):
                if row not in seen:
                    if len(seen) >= most:
                        seen.clear()
                    seen.add(row)
                    keep[i] = True
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
