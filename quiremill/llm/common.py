"""What the operators share: shared scratch space and connected components."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder below the checkpoint folder that holds the tables written between steps.
SCRATCH = "quiremill"
#: The part of it that this driver's tables are in.
_RUN = uuid.uuid4().hex
#: Rows of one key that a task may well take, whatever the number of tasks.
FAIR_ROWS = 2_000
#: Rows of a crowd that are compared with those near them in size in one go.
TILE = 512
#: Rows of each class of sizes of a crowd that its others are compared with before all pairs are; classes are dealt in so many ways.
CLASS_HUBS, DEALINGS = 3, 2
#: Spark's setting by which the shuffle files of a query are deleted as soon as it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quiremill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{SCRATCH}/{_RUN}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: later steps need no earlier executor, nor its shuffle files."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this driver's operators have written, once their results are no longer read."""
    _delete(spark, _scratch(spark))


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{SCRATCH}/" in name:
            _delete(spark, name)


def join_hot(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key, where a key may hold most of ``left``.

    Keys with more rows than a fair partition are joined by broadcasting their rows of ``right``: there are
    no more of them than shuffle partitions, whatever the data. ``left`` is read twice, so it should be a written
    table or a scan.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(left.groupBy(on).agg(F.count("*").alias("_ql_n")).where(f"_ql_n > {FAIR_ROWS}"), "key-counts")
    total = counts.agg(F.sum("_ql_n")).first()[0]
    if total is None:
        return left.join(right, on)
    share = max(FAIR_ROWS, total // parts)  # at most ``parts`` keys are above it
    hot = counts.where(f"_ql_n > {share}").select(on)
    few = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right, on)
    return left.join(few, on).unionByName(rest)


def meetings(keyed: DataFrame, who: str, crowded: int) -> DataFrame:
    """Written rows of ``keyed`` (k, who, ...) that share their k with another, with their number n and a hub.

    The hub of a k with more than ``crowded`` rows is the one that most others meet under such keys, as an original
    meets all its copies, and these may not meet each other; ties go to the smallest. No group is gathered.
    """
    shared = written(keyed.groupBy("k").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low < high").select("k"), "shared-keys")
    members = written(keyed.join(shared, "k", "left_semi").distinct(), "members")
    forget(shared)
    counts = written(members.groupBy("k").agg(F.count("*").alias("n")), "member-counts")
    if counts.where(f"n > {crowded}").isEmpty():
        return members.join(counts, "k").withColumn("hub", F.lit(None).cast(keyed.schema[who].dataType))
    full = written(join_hot(members, counts.where(f"n > {crowded}"), "k"), "crowds")
    met = full.groupBy(who).agg(F.sum("n").alias("met"))
    hubs = full.join(met, who).groupBy("k").agg(F.max_by(who, F.struct("met", F.hash(who), who)).alias("hub"))
    few = members.join(counts.where(f"n <= {crowded}"), "k").withColumn("hub", F.lit(None).cast(keyed.schema[who].dataType))
    found = written(few.unionByName(join_hot(full, hubs, "k")), "meetings")
    for part in (members, counts, full):
        forget(part)
    return found


def met_pairs(met: DataFrame, who: str, crowded: int, size: str | None = None, share: float = 0.0) -> DataFrame:
    """(a, b) of :func:`meetings`: all pairs under small keys, the hub with each other under crowded ones.

    Under small keys pairs are left out whose ``size`` differ by more than ``share`` of the larger one. What crowded
    keys leave apart is for :func:`mixed_crowds` and :func:`pairs_apart`.
    """
    few = met.where(f"n <= {crowded}").withColumn("size", F.col(size) if size else F.lit(0))
    left, right = (few.select("k", F.col(who).alias(x), F.col("size").alias(f"s{x}")) for x in "ab")
    fits = F.abs(F.col("sa") - F.col("sb")) <= F.floor(F.greatest("sa", "sb") * share + 1e-9)
    inner = left.join(right, "k").where("a < b").where(fits)
    star = met.where(f"n > {crowded} and {who} != hub").select(F.least("hub", who).alias("a"), F.greatest("hub", who).alias("b"))
    return written(inner.select("a", "b").unionByName(star).distinct(), "pairs")


def mixed_crowds(met: DataFrame, groups: DataFrame, who: str, crowded: int) -> DataFrame:
    """Written rows of :func:`meetings` under crowded keys whose rows are not all in one of ``groups``, with their group g.

    Its own result may be given again with further groups.
    """
    crowds = met.where(f"n > {crowded}").join(groups, F.col(who) == F.col("node"), "left").withColumn("g", F.coalesce("component", who))
    crowds = written(crowds.drop("node", "component", "hub"), "crowds-by-group")
    mixed = crowds.groupBy("k").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("k")
    found = written(join_hot(crowds, mixed, "k"), "mixed-crowds")
    forget(crowds)
    return found


def hub_pairs(crowds: DataFrame, who: str, size: str, share: float) -> DataFrame:
    """Written (a, b) of rows of :func:`mixed_crowds` with the hubs of their class of sizes, in different groups and of sizes that allow it.

    A crowd's one hub says nothing of rows far from it in size, which may be alike among each other. Hubs are chosen by
    a hash; bounds of classes differ from dealing to dealing, so that classes join. The pairs grow with the rows.
    """
    width = -math.log(1 - share - 1e-6)
    classes = [F.struct(F.lit(i).alias("i"), F.xxhash64("k", F.lit(i), F.floor(F.log(F.col(size)) / width + i / DEALINGS)).alias("at")) for i in range(DEALINGS)]
    dealt = crowds.select(F.explode(F.array(*classes)).alias("c"), F.col(who).alias("w"), "g", F.col(size).alias("s"))
    dealt = written(dealt.select("c.i", "c.at", "w", "g", "s"), "crowds-dealt")
    # The hash knows nothing of the key: crowds of the same rows have the same hubs.
    chosen = [F.min_by(F.struct("w", "g", "s"), F.struct(F.xxhash64("w", "i", F.lit(n)), "w")) for n in range(CLASS_HUBS)]
    met = join_hot(dealt, dealt.groupBy("at").agg(F.array(*chosen).alias("hubs")), "at")
    fits = lambda x: F.abs(x["s"] - F.col("s")) <= F.floor(F.greatest(x["s"], F.col("s")) * share + 1e-9)
    met = met.select("w", F.explode(F.filter("hubs", lambda x: (x["g"] != F.col("g")) & fits(x))).alias("hub"))
    found = written(met.select(F.least("w", "hub.w").alias("a"), F.greatest("w", "hub.w").alias("b")).distinct(), "hub-pairs")
    forget(dealt)
    return found


def pairs_apart(crowds: DataFrame, who: str, size: str, share: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, and ``carried`` of both) of all rows of :func:`mixed_crowds` that share a key, are in different groups and
    whose ``size``, 1 at least, differ by at most ``share`` of the larger one; each pair comes once.

    Rows of one crowd are dealt by classes of size, of which a row meets its own and the next one, and by tiles.
    """
    width = -math.log(1 - share - 1e-6)
    own = crowds.groupBy(who).agg(F.array_sort(F.collect_list("k")).alias("ks"))  # a row's own keys are few
    held = crowds.join(own, who).select(
        "k", F.col(who).alias("w"), "g", F.col(size).alias("s"), "ks", *carried,
        F.floor(F.log(F.col(size)) / width).cast("int").alias("class"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"),
    )
    held = written(held, "crowds-dealt")
    kept = lambda side: [F.col(c).alias(f"{c}{side}") for c in ("w", "g", "s", "ks", "class", *carried)]
    left = held.select("k", F.col("class").alias("at"), F.pmod(F.xxhash64("w"), F.col("tiles")).cast("int").alias("tile"), *kept("a"))
    right = held.select("*", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("at"))
    right = right.select("k", "at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *kept("b"))
    fits = F.abs(F.col("sa") - F.col("sb")) <= F.floor(F.greatest("sa", "sb") * share + 1e-9)
    once = (F.col("classb") > F.col("classa")) | (F.col("wa") < F.col("wb"))
    first = F.element_at(F.array_intersect("ksa", "ksb"), 1) == F.col("k")
    both = left.join(right, ["k", "at", "tile"]).where((F.col("ga") != F.col("gb")) & fits & once).where(first)
    return both.select(F.col("wa").alias("a"), F.col("wb").alias("b"), *[f"{c}{x}" for c in carried for x in "ab"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node that each node of an edge list reaches.

    ``edges`` has the columns a and b of one orderable type; null ends and loops are
    ignored. Returns (node, component) for every node with an edge to another node.

    Alternates the large-star and small-star steps: every step keeps at most one row
    for each edge and looks only at a group's smallest neighbour, so a hub of any size
    is a partial aggregate and a join whose large side can be split, never a list.
    The number of rounds is logarithmic in the longest chain; ``rounds`` is only a
    guard against edge lists that never settle and raises when it is passed.
    """
    links = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = written(links.distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
                    F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
                )
            ).alias("e")
        )
        small = small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a != b").distinct()
        following = written(small, "links")
        state = following.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)
        ).first()
        forget(links)
        links = following
        if state == before:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined_groups(groups: DataFrame, more: DataFrame) -> DataFrame:
    """Groups (node, component) once further links (a, b) are added to them."""
    return connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))
