"""Candidate selection: de-duplication, budgets, quotas and run summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions import rights
from prefloom.operators.components import connected
from prefloom.operators.ordered import first_per_key, id_chunk, ranked, running, top_per_key
from prefloom.session import landed


def rank_order(with_model: bool = True) -> list[Column]:
    """Score first when a model exists, discovery order otherwise."""
    return [-F.col("score"), F.col("discovery_index")] if with_model else [F.col("discovery_index")]


def identity() -> Column:
    return F.coalesce(F.nullif(F.col("provider_sha1"), F.lit("")), F.nullif(F.col("source_url"), F.lit("")),
                      F.col("discovery_index").cast("string"))


def unseen(candidates: DataFrame, provenance: DataFrame) -> DataFrame:
    """Candidates whose source and page links are not in their user's library.

    The OR over links is two equi anti joins.
    """
    urls = provenance.select("user_id", "source_url").filter(F.col("source_url") != "").distinct()
    pages = provenance.select("user_id", "page_url").filter(F.col("page_url") != "").distinct()
    return candidates.join(urls, ["user_id", "source_url"], "left_anti").join(pages, ["user_id", "page_url"], "left_anti")


def first_seen(candidates: DataFrame, group: Sequence[str], order: str, keys: Sequence[str], settled: int = 10_000) -> DataFrame:
    """Rows that share no key with an earlier *kept* row of their group.

    A dropped row does not register its keys, so first occurrence per key is not enough. Each key links its
    rows to their first one, never to each other, and rows fall into components of such links. A component is
    scanned on its own, ``settled`` of its first rows at a time; what those keep drops every
    later row that shares a key. Rounds follow the size of the largest component over that number,
    not the longest chain of conflicts. ``order`` is unique in a group.
    """
    group = list(group)
    row = [*group, order]
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys]
    links = candidates.select(*row, F.explode(F.array(*kinds)).alias("link")).select(*row, "link.kind", "link.key")
    links = landed(links.filter(F.coalesce(F.col("key"), F.lit("")) != ""))
    kept = [candidates.select(*row).join(links.select(*row).distinct(), row, "left_anti")]
    first = links.groupBy(*group, "kind", "key").agg(F.min(order).alias("_first"))
    node = lambda name: F.struct(*group, F.col(name).alias("at"))
    shared = links.join(first, [*group, "kind", "key"]).where(F.col(order) != F.col("_first"))
    parts = connected(shared.select(node(order).alias("a"), node("_first").alias("b")))
    parts = landed(parts.select(*[F.col(f"node.{g}").alias(g) for g in group], F.col("node.at").alias(order), F.col("component.at").alias("_part")))
    kept.append(links.select(*row).distinct().join(parts, row, "left_anti"))
    open_rows = landed(links.join(parts, row).groupBy(*row, "_part").agg(F.collect_set(F.struct("kind", "key")).alias("_keys")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.select(*row).schema)

    where = [*group, "_part"]

    def scan(batches):
        part, seen = None, set()
        for batch in batches:
            stays = []
            owners = zip(*[batch[k].to_pylist() for k in where]) if batch.num_rows else ()
            for owner, keys_ in zip(owners, batch["_keys"].to_pylist()):
                if owner != part:
                    part, seen = owner, set()
                own = [(k["kind"], k["key"]) for k in keys_]
                stays.append(seen.isdisjoint(own))
                if stays[-1]:
                    seen.update(own)
            yield batch.select(row).filter(pa.array(stays, pa.bool_()))

    def scanned(rows: DataFrame) -> DataFrame:
        return rows.repartition(*where).sortWithinPartitions(*where, order).mapInArrow(scan, schema)

    while True:
        largest = open_rows.groupBy(*where).count().agg(F.max("count")).first()[0] or 0
        if largest <= settled:
            kept.append(scanned(open_rows))
            break
        head = landed(top_per_key(open_rows, where, [F.col(order)], settled, "_n", spread=order).drop("_n"))
        winners = landed(scanned(head))
        kept.append(winners)
        rest = open_rows.join(head.select(*row), row, "left_anti")
        taken = links.join(winners, row).select(*group, "kind", "key").distinct()
        beaten = links.join(taken, [*group, "kind", "key"], "left_semi").select(*row).distinct()
        open_rows = landed(rest.join(beaten, row, "left_anti"))
    return candidates.join(reduce(DataFrame.unionByName, kept), row, "left_semi")


def gate_reason(max_bytes: int) -> Column:
    """Rights gate, thumbnail gate and size gates in order."""
    return F.coalesce(rights.rejection_reason(), rights.thumbnail_reason(), rights.source_size_reason(max_bytes))


def rejection_histogram(reasons: DataFrame) -> DataFrame:
    return reasons.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("rejected")).orderBy("reason")


def one_per_action(candidates: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First finalist per action in the given order."""
    return first_per_key(candidates, ["run_id", "action_id"], order)


def exploration_quota(allowance: int) -> int:
    return max(1, math.ceil(allowance * c.CANDIDATE_EXPLORATION))


def exploration_key(day: str) -> Column:
    return F.sha2(F.concat_ws(":", F.col("user_id"), F.lit(day), identity()), 256)


def _explore_rest(rows: DataFrame, taken: DataFrame, keep: int, day: str) -> DataFrame:
    """First ``keep`` rows per run by exploration key outside ``taken`` actions.

    ``rows`` holds one row per action. Enough rows are kept to stay full without ``taken``.
    """
    order = [exploration_key(day), *rank_order()]
    drawn = top_per_key(rows, ["run_id"], order, keep, "draw")
    left = drawn.join(taken.select("run_id", "action_id"), ["run_id", "action_id"], "left_anti")
    return top_per_key(left, ["run_id"], [F.col("draw")], keep, "turn")


def select_candidates(candidates: DataFrame, allowance: int, day: str, with_model: bool = True) -> DataFrame:
    """Taste and exploration finalists per run (or the first ones in curated mode)."""
    distinct = one_per_action(candidates, rank_order(with_model))
    if not with_model:
        chosen = top_per_key(distinct, ["run_id"], rank_order(False), allowance)
        return chosen.withColumn("mode", F.lit("curated")).drop("position")
    quota = exploration_quota(allowance)
    sizes = distinct.groupBy("run_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("explore", F.least("n", F.lit(quota)))
    sizes = sizes.withColumn("exploit", F.greatest(F.lit(0), F.least(F.lit(allowance), "n") - F.col("explore")))
    best = top_per_key(distinct, ["run_id"], rank_order(), allowance)
    taste = best.join(sizes, "run_id").filter(F.col("position") <= F.col("exploit")).drop("n", "explore", "exploit", "position")
    rest = _explore_rest(distinct, taste, allowance + quota, day).join(sizes, "run_id").filter(F.col("turn") <= F.col("explore"))
    explored = rest.drop("n", "explore", "exploit", "turn", "draw")
    return taste.withColumn("mode", F.lit("taste")).unionByName(explored.withColumn("mode", F.lit("exploration")))


def admit(candidates: DataFrame, allowance: int, day: str) -> DataFrame:
    """Quota admission with backfill, one candidate per action; ``ok`` marks attempts that succeed.

    A failed attempt is replaced by the next one in rank order; an unmet taste quota is not
    moved to exploration.
    """
    quota = exploration_quota(allowance)
    groups = candidates.groupBy("run_id").agg(F.count_distinct("action_id").alias("n"))
    groups = groups.withColumn("desired", F.least(F.lit(allowance), "n")).withColumn("explore", F.least("desired", F.lit(quota)))
    good = candidates.filter("ok")
    best = top_per_key(one_per_action(good, rank_order()), ["run_id"], rank_order(), allowance)
    taste = best.join(groups, "run_id").filter(F.col("position") <= F.col("desired") - F.col("explore"))
    by_draw = one_per_action(good, [exploration_key(day), *rank_order()])
    rest = _explore_rest(by_draw, taste, allowance + quota, day).join(groups, "run_id").filter(F.col("turn") <= F.col("explore"))
    return taste.select(*candidates.columns, F.lit("taste").alias("mode")).unionByName(
        rest.select(*candidates.columns, F.lit("exploration").alias("mode"))
    )


def round_robin(candidates: DataFrame, limit: int, categories: Sequence[str] | None = None) -> DataFrame:
    """Balanced stream over categories: turn by turn, each identity once, first ``limit`` rows.

    Within a turn categories follow the order of ``categories``, the configured list; others, and
    all of them without a list, follow by name. A duplicate uses its category's turn but does not
    count.
    """
    listed = F.array_position(F.array(*[F.lit(k) for k in categories]), F.col("source_category")) if categories else F.lit(0)
    place = F.when(listed > 0, listed).otherwise(F.lit(len(categories or ()) + 1))
    turns = ranked(candidates, ["source_category"], ["discovery_index"], id_chunk("discovery_index"), "turn")
    keyed = turns.withColumn("_identity", identity())
    keyed = keyed.withColumn("_place", place)
    order = ["turn", "_place", "source_category"]
    return first_per_key(keyed, ["_identity"], order).orderBy(*order).limit(limit).drop("_identity", "_place")


def byte_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """Admit in order while the cumulative size stays within the budget (prefix form)."""
    summed = running(candidates, ["run_id"], ["discovery_index"], id_chunk("discovery_index"), {"used_bytes": F.col("size")})
    return summed.withColumn("admitted", F.col("used_bytes") <= budget)


def byte_budget_skipping(candidates: DataFrame, budget: int, fold_rows: int = 1 << 17) -> DataFrame:
    """Exact form for runs of any size: what does not fit is skipped and the next row is tried.

    The rows of a run of at most ``fold_rows`` rows stream through a fold that keeps one number. Longer runs are settled
    together in rounds of prefix sums, at most one for each binary digit of the budget. A null size is 0; a negative one
    counts like any other, and its run is folded. ``discovery_index`` is unique in a run.
    """
    rows = candidates.select("run_id", "discovery_index", F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    long = landed(sizes.filter((F.col("n") > fold_rows) & (F.col("least") >= 0) & F.col("run_id").isNotNull()).select("run_id"))
    if budget < 0 or long.isEmpty():
        return _folded_budget(rows, budget)
    short = _folded_budget(rows.join(long, "run_id", "left_anti"), budget)
    return short.unionByName(_budget_in_rounds(landed(rows.join(long, "run_id", "left_semi")), long, budget))


def _folded_budget(rows: DataFrame, budget: int) -> DataFrame:
    def admit(batches):
        import pandas as pd

        run, used = None, 0
        for batch in batches:
            keep = []
            for key, size in zip(batch["run_id"], batch["size"]):
                if key != run:
                    run, used = key, 0
                fits = used + size <= budget
                used += size if fits else 0
                keep.append(fits)
            yield batch.loc[pd.Series(keep, index=batch.index, dtype=bool), ["run_id", "discovery_index"]]

    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "discovery_index")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered.mapInPandas(admit, f"run_id {kind['run_id']}, discovery_index {kind['discovery_index']}")


def _budget_in_rounds(rows: DataFrame, runs: DataFrame, budget: int) -> DataFrame:
    """Admission by the highest binary digit of what is left of each run's budget.

    While that digit stays, rows below it always fit, and the first larger row that fits clears it. A round admits
    all small rows up to the row that clears the digit, and that row; the next round starts behind it.
    """
    state = runs.select("run_id", F.lit(budget).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("after"))
    kept = []
    while True:
        live = rows.join(state, "run_id").filter((F.col("size") <= F.col("left")) & (F.col("after").isNull() | (F.col("discovery_index") > F.col("after"))))
        digit = F.expr("shiftleft(1L, length(bin(left)) - 1)")
        live = live.withColumn("digit", digit).withColumn("small", F.col("size") < F.col("digit"))
        chunk = id_chunk("discovery_index")
        summed = running(live, ["run_id"], ["discovery_index"], chunk, {"before": F.when(F.col("small"), F.col("size")).otherwise(0)}, inclusive=False)
        rest = F.col("left") - F.col("before") - F.col("size")
        clears = F.when(F.col("small"), (F.col("size") > 0) & (rest < F.col("digit"))).otherwise(rest >= 0)
        summed = landed(summed.select("run_id", "discovery_index", "size", "left", "small", rest.alias("rest"), clears.alias("clears")))
        ends = landed(summed.filter("clears").groupBy("run_id").agg(F.min_by(F.struct("discovery_index", "rest"), "discovery_index").alias("end")))
        until = summed.join(ends, "run_id", "left")
        at = F.col("discovery_index")
        inside = F.col("end").isNull() | (at < F.col("end.discovery_index"))
        kept.append(until.filter((F.col("small") & inside) | (at == F.col("end.discovery_index"))).select("run_id", "discovery_index"))
        if ends.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        state = ends.select("run_id", F.col("end.rest").alias("left"), F.col("end.discovery_index").cast("bigint").alias("after"))


def pool_cap(approved: DataFrame, target: int) -> DataFrame:
    """Mark approved rows beyond the scoring target as censored."""
    placed = ranked(approved, ["run_id"], ["discovery_index"], id_chunk("discovery_index"))
    return placed.withColumn("censored", F.col("position") > target)


def scoring_pool(candidates: DataFrame, allowance: int, cap: int, with_model: bool) -> DataFrame:
    """First rows of a run up to its collection target."""
    target = cap if with_model else min(cap, allowance * c.CURATED_OVERFETCH)
    return top_per_key(candidates, ["run_id"], [F.col("discovery_index")], target)


def local_pool(candidates: DataFrame, limit: int, scored: bool, eligible: Column) -> DataFrame:
    """The single-machine pool of a run: three times ``limit`` with a scorer, ``limit`` without.

    Only eligible rows among the first ones of a scan budget enter it; the budget follows the pool's size.
    """
    pool = limit * (c.LOCAL_POOL_FACTOR if scored else 1)
    budget = max(pool * c.LOCAL_SCAN_FACTOR, c.LOCAL_SCAN_FLOOR) if pool else 0
    scanned = top_per_key(candidates, ["run_id"], [F.col("discovery_index")], budget, "scanned", spread="discovery_index")
    return top_per_key(scanned.filter(eligible).drop("scanned"), ["run_id"], [F.col("discovery_index")], pool, spread="discovery_index")


def action_diagnostics(candidates: DataFrame) -> DataFrame:
    """Seen and eligible candidates and the best taste score per action; ``eligible`` flags rows."""
    taste = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    return candidates.groupBy("action_id").agg(
        F.count("*").alias("candidates_seen"), F.count_if("eligible").alias("candidates_eligible"),
        F.max(F.when(F.col("eligible"), taste)).alias("proxy_reward"),
    )


def run_summary(outcomes: DataFrame, allowance: int) -> DataFrame:
    """One row per run; ``outcomes`` has run_id, action_id, reason, near_duplicate and mode."""
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("reason").isNull()).alias("eligible"),
        F.count_if("near_duplicate").alias("near_duplicates"),
        F.count_if(F.col("mode").isNotNull()).alias("imported"),
        F.count_if(F.col("mode") == "exploration").alias("exploration_selected"),
        F.count_distinct("action_id").alias("actions_recorded"),
        F.greatest(F.lit(0), F.lit(allowance) - F.count_if(F.col("mode").isNotNull())).alias("shortfall"),
    )


def content_lookup(staged: DataFrame, images: DataFrame, user_images: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Exact-content matches of staged files: existing item, linked already, stored vector."""
    known = staged.join(images.select("sha256", F.col("image_id").alias("existing_id")), "sha256", "left")
    links = user_images.select("user_id", F.col("image_id").alias("existing_id"), F.lit(True).alias("_linked"))
    vectors = embeddings.select(F.col("image_id").alias("existing_id"), F.lit(True).alias("_stored"))
    return (
        known.join(links, ["user_id", "existing_id"], "left")
        .join(vectors, "existing_id", "left")
        .withColumn("already_linked", F.coalesce("_linked", F.lit(False)))
        .withColumn("has_embedding", F.coalesce("_stored", F.lit(False)))
        .drop("_linked", "_stored")
    )


def reconcile(library: DataFrame, listing: DataFrame) -> DataFrame:
    """Compare library rows with an object listing by path."""
    joined = library.join(listing, "path", "left")
    status = (
        F.when(F.col("object_bytes").isNull(), "missing")
        .when(F.col("object_bytes") != F.col("bytes"), "size-mismatch")
        .when(F.col("object_sha256") != F.col("sha256"), "digest-mismatch")
        .when((F.col("object_width") != F.col("width")) | (F.col("object_height") != F.col("height")), "dimension-mismatch")
        .otherwise("present")
    )
    return joined.withColumn("status", status)


def creator_quota(candidates: DataFrame, per_creator: int) -> DataFrame:
    """Best candidates per run and creator."""
    return top_per_key(candidates, ["run_id", "creator"], rank_order(), per_creator)
