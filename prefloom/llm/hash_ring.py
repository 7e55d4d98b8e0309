"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Shards stand on a ring of 2^20 cells, each at many places (virtual nodes). A document's id falls on
a cell and belongs to the next place clockwise. A shard takes rows up to its bound; what overflows
a full shard continues clockwise to the next place whose shard has room. Rows are placed in rounds:
in each, the rows still without a shard go to their next open shard, which admits them in the order
of the ring as far as it has room. That is the ring's usual rule for one order of arrival.

All decisions are taken on counts per arc between two places, a table of fixed size; a row only needs its
number inside its arc. Numbers come from counts per cell and a window inside each cell, so no
task sees more than a cell. Everything is DataFrame functions.

Nulls: a null id is an id of its own, a null text has no bytes. Repeated rows and rows of one id are
rows like any other and share a cell; a cell of more than ``hot`` rows is dealt over several windows. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefloom.llm.common import NULL_ID, landed, original_id, ready

CELL_BITS = 20
BLOCK_BITS = 10
#: Rows of a cell up to which one window numbers them.
HOT = 1 << 20


def place(name: Column) -> Column:
    """The 32 bits that say where a name stands on the ring."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """Arcs of the ring: arc, shard, above (cell before it), cell (its place), in ring order.

    The arc of the first place also has the cells behind the last one; see :func:`spans`.
    """
    nodes = spark.range(shards * replicas, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica")
    )
    name = F.concat_ws(":", F.lit("shard"), "shard", "replica")
    cell = F.shiftright(place(name), 32 - CELL_BITS)
    order = Window.partitionBy(F.lit(0)).orderBy("cell", "shard", "replica")
    return nodes.withColumn("cell", cell).select(
        (F.row_number().over(order) - 1).alias("arc"), "shard", F.coalesce(F.lag("cell").over(order), F.lit(-1)).alias("above"), "cell"
    )


def spans(arcs: DataFrame) -> DataFrame:
    """arc, above, upto for every block of cells that the arc meets: a table of fixed size."""
    rest = arcs.agg(F.max("cell").alias("above")).select(F.lit(0).alias("arc"), "above", F.lit((1 << CELL_BITS) - 1).cast("long").alias("upto"))
    whole = arcs.select("arc", "above", F.col("cell").alias("upto")).unionByName(rest).where("upto > above")
    first, last = F.shiftright(F.col("above") + 1, BLOCK_BITS), F.shiftright("upto", BLOCK_BITS)
    return whole.select(F.explode(F.sequence(first, last)).alias("block"), "arc", "above", "upto")


def bounds(arcs: DataFrame, total: int, shards: int, load: float | None) -> DataFrame:
    """shard, room: the total dealt out evenly, or ``load`` times the mean rounded up."""
    if load is None:
        room = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    else:
        if load < 1:
            raise ValueError("load must be at least 1")
        room = F.ceil(F.lit(float(load)) * total / shards)
    return arcs.select("shard").distinct().select("shard", room.cast("long").alias("room"))


def placements(arcs: DataFrame, counts: DataFrame, rooms: DataFrame) -> DataFrame:
    """arc, first, after, shard, slot: rows numbered first to after - 1 of an arc go to the shard from slot on.

    ``counts`` holds the rows of each arc. All tables have a row per arc or shard at most, so one task takes
    each; every round fills a shard or ends.
    """
    state = arcs.select("arc", "shard").join(rooms, "shard").join(counts, "arc", "left").select(
        "arc", "shard", "room", F.lit(0).cast("long").alias("used"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("first")
    )
    whole = Window.partitionBy(F.lit(0))
    onward = whole.orderBy(F.desc("arc")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = whole.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    queue = Window.partitionBy("to.shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.when(F.col("room") > 0, F.struct("shard", "room", "used"))
    before = F.coalesce(F.sum("n").over(queue), F.lit(0))
    done, waiting = [], 1
    while waiting:
        # the next open place is at or behind the arc, else the first one from the ring's start
        asked = state.coalesce(1).withColumn("to", F.coalesce(F.last(open_, True).over(onward), F.first(open_, True).over(around)))
        asked = asked.withColumn("slot", F.col("to.used") + before)
        asked = asked.withColumn("admitted", F.greatest(F.lit(0), F.least("n", F.col("to.room") - before)))
        round_ = landed(asked.select("arc", "shard", "room", "used", "n", "first", F.col("to.shard").alias("taker"), "slot", "admitted"))
        done.append(round_)
        waiting = round_.agg(F.sum(F.col("n") - F.col("admitted"))).first()[0]
        took = round_.groupBy(F.col("taker").alias("shard")).agg(F.sum("admitted").alias("took"))
        gone = F.coalesce("took", F.lit(0))
        state = round_.join(F.broadcast(took), "shard", "left").select(
            "arc", "shard", (F.col("room") - gone).alias("room"), (F.col("used") + gone).alias("used"),
            (F.col("n") - F.col("admitted")).alias("n"), (F.col("first") + F.col("admitted")).alias("first"),
        )
    placed = [
        round_.where("admitted > 0").select("arc", "first", (F.col("first") + F.col("admitted")).alias("after"), F.col("taker").alias("shard"), "slot")
        for round_ in done
    ]
    return reduce(DataFrame.unionByName, placed)


def assign(documents: DataFrame, shards: int = 40, load: float | None = None, replicas: int = 64, hot: int = HOT) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document.

    Without ``load`` the bounds are exact shares, so counts are at most one apart. With ``load`` (say
    1.25) a shard takes up to that multiple of the mean, and a further shard moves few rows.
    ``replicas`` is the number of places a shard has on the ring.
    """
    if shards < 1 or replicas < 1:
        raise ValueError("shards and replicas must be positive")
    spark = ready(documents)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = documents.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        place(doc_id.cast("string")).alias("place"), F.monotonically_increasing_id().alias("row"),
    )
    rows = landed(rows.withColumn("cell", F.shiftright("place", 32 - CELL_BITS)))
    cells = landed(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    arcs = ring(spark, shards, replicas)
    crowded = cells.where(F.col("n") > hot)
    if crowded.isEmpty():
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
        cells = cells.withColumn("piece", F.lit(0).cast("long"))
    else:
        split = crowded.select("cell", F.ceil(F.col("n") / hot).alias("pieces"))
        rows = landed(rows.join(split, "cell", "left").withColumn("piece", F.coalesce(F.pmod("row", "pieces"), F.lit(0))).drop("pieces"))
        cells = rows.groupBy("cell", "piece").agg(F.count(F.lit(1)).alias("n"))
    where = (F.col("cell") > F.col("above")) & (F.col("cell") <= F.col("upto"))
    cells = cells.withColumn("block", F.shiftright("cell", BLOCK_BITS)).join(F.broadcast(spans(arcs)), "block").where(where)
    # ring order inside an arc: the wrapped part of the first arc comes before its head
    ahead = Window.partitionBy("arc").orderBy(F.col("above").desc(), "cell", "piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = landed(cells.select("cell", "piece", "arc", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")))
    counts = cells.groupBy("arc").agg(F.sum("n").alias("n"))
    plan = placements(arcs, counts, bounds(arcs, total, shards, load))
    inside = Window.partitionBy("cell", "piece").orderBy("place", "doc_id", "text_crc32", "size", "row")
    numbered = rows.join(cells.drop("n"), ["cell", "piece"]).withColumn("number", F.col("offset") + F.row_number().over(inside) - 1)
    within = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("after"))
    # the plan has at most a row per arc and shard, whatever the data
    return numbered.join(F.broadcast(plan), "arc").where(within).select(
        original_id(), "size", "text_crc32", "shard", (F.col("slot") + F.col("number") - F.col("first")).alias("slot")
    )


def sharded(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Documents in shards of equal row counts, with the law they keep."""
    return assign(documents, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
