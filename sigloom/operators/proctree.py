"""Process trees as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.rules import spawn_suspect


def nodes(events: DataFrame) -> DataFrame:
    """One node of each (host, pid): the last event wins."""
    last = F.max_by(F.struct("ppid", "image", "parent_image", "event_id", "command_line", "username"), F.struct("us", "event_id"))
    return events.filter("host IS NOT NULL AND pid IS NOT NULL").groupBy("host", "pid").agg(last.alias("n")).select("host", "pid", "n.*")


def parents(tree: DataFrame) -> DataFrame:
    """Nodes with the parent's image: the event's own, else that of (host, ppid), else root."""
    above = tree.select("host", F.col("pid").alias("ppid"), F.col("image").alias("above"))
    return tree.join(above, ["host", "ppid"], "left").withColumn("parent", F.coalesce("parent_image", "above", F.lit("root"))).drop("above")


def child_images(with_parents: DataFrame) -> DataFrame:
    """(parent, image, n): child nodes of each parent by image, a row each."""
    return with_parents.groupBy("parent", "image").agg(F.count("*").alias("n"))


def children(with_parents: DataFrame) -> DataFrame:
    """(parent, n_children, child_images): number of child nodes and all their distinct images.

    The images are one row's value; child_images() has them as rows."""
    return child_images(with_parents).groupBy("parent").agg(F.sum("n").alias("n_children"), F.sort_array(F.collect_list("image")).alias("child_images"))


def ancestors(tree: DataFrame, scratch: str, depth: int = 10) -> DataFrame:
    """(host, pid, chain): ancestors' pids from oldest to nearest; stops at depth and at a pid seen before.

    The nodes are written below `scratch` once, then each round doubles the length of the known
    chains, which are written every second round; chains that ended are out of the joins.
    """
    spark = tree.sparkSession
    write = lambda df, name: (df.write.parquet(f"{scratch}/{name}"), spark.read.schema(df.schema).parquet(f"{scratch}/{name}"))[1]
    nodes_ = write(tree.select("host", "pid", "ppid"), "nodes")
    known = nodes_.select("host", F.col("pid").alias("ppid"), F.lit(True).alias("known"))
    # nearest ancestor first; `top` is the last one while it may have one itself
    start = nodes_.join(known, ["host", "ppid"], "left")
    none = F.array().cast("array<bigint>")
    chains = start.select("host", "pid", F.when(F.col("known"), F.array("ppid")).otherwise(none).alias("up"), F.when(F.col("known"), F.col("ppid")).alias("top"))
    length, round_ = 1, 0
    while length < depth:
        if round_ and round_ % 2 == 0:
            chains = write(chains, f"chains-{round_}")
        more = chains.filter("size(up) > 0").select("host", F.col("pid").alias("top"), F.col("up").alias("further"), F.col("top").alias("end"))
        grown = chains.filter("top IS NOT NULL").join(more, ["host", "top"], "left")
        grown = grown.select("host", "pid", F.concat("up", F.coalesce("further", none)).alias("up"), "end")
        chains = grown.withColumnRenamed("end", "top").unionByName(chains.filter("top IS NULL"))
        length, round_ = 2 * length, round_ + 1

    def step(state, pid):
        again = state["done"] | F.array_contains(state["chain"], pid) | (pid == F.col("pid"))
        return F.struct(F.when(again, state["chain"]).otherwise(F.concat(F.array(pid), state["chain"])).alias("chain"), again.alias("done"))

    cut = F.aggregate(F.slice("up", 1, depth), F.struct(none.alias("chain"), F.lit(False).alias("done")), step, lambda s: s["chain"])
    return chains.select("host", "pid", cut.alias("chain"))


def spawn_report(events: DataFrame, tree: DataFrame) -> DataFrame:
    """Process events whose image was started by a parent it should not have, with command line and user."""
    above = parents(tree).select("host", "pid", F.col("parent").alias("__parent"))
    rows = events.filter(F.col("image").isNotNull()).join(above, ["host", "pid"]).drop("parent_image").withColumnRenamed("__parent", "parent_image")
    return spawn_suspect(rows).select("event_id", "host", "parent", "child", "command_line", "username", "score")

