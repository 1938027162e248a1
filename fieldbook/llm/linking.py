"""Linking vertices that share buckets, without emitting all pairs of a bucket.

Both near-duplicate texts and copied images come down to this: members (bucket, v, tv, s) name the
buckets a vertex lies in, a confirming function keeps the pairs that really belong together, and
what is wanted are the components of the confirmed pairs.

A bucket's pivot is its smallest vertex. First each vertex is paired with the smallest of its pivots only, so a group
of copies that shares many buckets makes one pair a vertex. Then buckets whose members still lie in several
components stay open, and each vertex goes on to further pivots of other components: up to 4, 16, 64 and so on at a
time, until none is left. What is still open after that is compared across components, never inside one; sketches
decide inside the join which pairs go on to be confirmed, each once. So every pair in a bucket is confirmed, refused, ruled out by its sketches, or already inside one component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldbook.llm.scratch import written


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(v, c): for each vertex of the edges (a, b), the smallest vertex of its component.

    Every round a vertex takes the smallest name among its neighbours and its name's name. Labels are
    a written table each round; the driver only gets how many changed.
    """
    pairs = edges.select("a", "b").where("a <> b")
    sym = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(sym.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")))
    for _ in range(max_rounds):
        near = sym.join(labels.select(F.col("v").alias("b"), "c"), "b").select(F.col("a").alias("v"), F.col("c").alias("n"))
        jump = labels.join(labels.select(F.col("v").alias("c"), F.col("c").alias("n")), "c").select("v", "n")
        step = labels.select("v", F.col("c").alias("n"), F.col("c").alias("old")).unionByName(near.union(jump), allowMissingColumns=True)
        seen = Observation()
        step = step.groupBy("v").agg(F.min("n").alias("c"), F.max("old").alias("old"))
        labels = written(step.observe(seen, F.count_if(F.col("c") != F.col("old")).alias("changed"))).select("v", "c")
        if not seen.get["changed"]:
            return labels
    raise RuntimeError("components did not settle")


def link_in_buckets(
    vertices: DataFrame,
    prepare: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
    alike: str = "true",
    close: str = "true",
    parts: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Confirmed edges (a, b), and their components (v, c).

    vertices: (bucket, v, tv, s). prepare gets the distinct (v, tv) that share a bucket, and returns
    their sketches (v, tv, f) and a function from distinct pairs (a, ta, b, tb) to the (a, b) that
    hold. alike is an SQL condition on s and sb, and close one on the sketches f and fb, that any
    pair worth confirming meets. Where only a part of f counts in a bucket, parts is an SQL expression for those of f whose
    bucket is in the array own, as array<struct<bucket, part>>; then f and fb in close are the arrays of a bucket's parts.
    """
    first = [F.min("v").alias("b"), F.min_by("tv", "v").alias("tb"), F.min_by("s", "v").alias("sb")]
    pivots = vertices.groupBy("bucket").agg(F.count("*").alias("times"), *first).where("times > 1").drop("times")
    members = written(vertices.join(written(pivots), "bucket"))
    sketches, confirm = prepare(members.select("v", "tv").distinct())
    side = F.struct("b", "tb")
    pairs = members.where("v <> b").where(alike).groupBy("v", "tv").agg(F.min(side).alias("p"))
    tried = written(pairs.select(F.col("v").alias("a"), F.col("tv").alias("ta"), "p.b", "p.tb"))
    links = written(confirm(tried))
    labels = components(links)

    still, quota = _open(members, labels), 4
    while True:
        left = still.where("v <> b and c <> cb").where(alike).groupBy("v", "tv").agg(F.collect_set(side).alias("p"))
        # a vertex has no more pivots than buckets
        done = tried.groupBy(F.col("a").alias("v"), F.col("ta").alias("tv")).agg(F.collect_set(side).alias("done"))
        left = left.join(done, ["v", "tv"], "left").select("v", "tv", F.array_except("p", F.coalesce("done", F.slice("p", 1, 0))).alias("p"))
        turn = left.select(F.col("v").alias("a"), F.col("tv").alias("ta"), F.explode(F.slice(F.array_sort("p"), 1, quota)).alias("p")).select("a", "ta", "p.b", "p.tb")
        turn, quota = written(turn), 4 * quota
        if not turn.limit(1).count():
            break
        tried, found = tried.union(turn), written(confirm(turn))
        if found.limit(1).count():
            links = links.union(found)
            labels = components(links)
            still = _open(still, labels)

    own = still.groupBy("v").agg(F.array_sort(F.collect_set("bucket")).alias("own"))
    if parts is None:
        # the sketch is one in all buckets, so each pair is looked at in the smallest of its common buckets
        full, once = still.join(own, "v").join(sketches, ["v", "tv"]), "array_min(array_intersect(own, ownb)) = bucket"
    else:
        each = sketches.join(own, "v").select("v", "tv", F.explode(F.expr(parts)).alias("e"))
        mine = each.groupBy("e.bucket", "v", "tv").agg(F.collect_list("e.part").alias("f"))
        full, once = still.join(mine, ["bucket", "v", "tv"]).withColumn("own", F.lit(None).cast("array<bigint>")), "true"
    full = written(full.select("bucket", "v", "tv", "s", "c", "f", "own", F.col("b").alias("pivot")))
    other = full.select("bucket", *[F.col(x).alias(y) for x, y in (("v", "b"), ("tv", "tb"), ("s", "sb"), ("c", "cb"), ("f", "fb"), ("own", "ownb"))])
    more = full.join(other, "bucket").where(f"v < b and v <> pivot and c <> cb and {alike} and {close} and {once}")
    more = more.select(F.col("v").alias("a"), F.col("tv").alias("ta"), "b", "tb")
    found = written(confirm(more if parts is None else more.distinct()))
    if found.limit(1).count():
        links = links.union(found)
        labels = components(links)
    return links, labels


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that have several components, with their component c and their pivot's cb."""
    named = members.drop("c", "cb").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    spread = named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("c", "v").alias("cb"))
    return written(named.join(written(spread.where("low <> high").select("bucket", "cb")), "bucket"))
