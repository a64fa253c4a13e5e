"""The best N items of every group by descending score bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.scratch import durable

#: Cells of the score histogram from which the band edges are taken; the histogram is all that reaches the driver.
HISTOGRAM_CELLS = 512


def valid_score(score: Column, low: float, high: float) -> Column:
    """A number within [low, high]; null, NaN and infinities are none."""
    return score.isNotNull() & ~F.isnan(score) & score.between(low, high)


def band_edges(scored: DataFrame, score: str, low: float, high: float, shares: Sequence[float]) -> list[float]:
    """Descending scores at which a band ends, so that the bands hold about ``shares`` of the rows.

    Edges fall between histogram cells, so rows of one score always share a band.
    """
    width = (high - low) / HISTOGRAM_CELLS
    cell = F.least(F.floor((F.col(score) - low) / width), F.lit(HISTOGRAM_CELLS - 1))
    counts = {r["cell"]: r["n"] for r in scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    total, seen, edges, targets = sum(counts.values()), 0, [], []
    for share in shares:
        targets.append((targets[-1] if targets else 0) + share)
    for at in range(HISTOGRAM_CELLS - 1, 0, -1):
        seen += counts.get(at, 0)
        if targets and total and seen >= targets[0] * total:
            edges.append(low + at * width)
            while targets and seen >= targets[0] * total:
                targets.pop(0)
    return edges


def latest_delivery(items: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``; a grouped max, so copies meet before the shuffle."""
    last = F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("last")
    return items.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in payload])


def top_n_per_group(
    items: DataFrame,
    group: str,
    score: str,
    ties: Sequence[str],
    keep: Sequence[str],
    n: int = 3,
    low: float = -1.0,
    high: float = 1.0,
    shares: Sequence[float] = (0.25, 0.35),
    histogram_of: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` rows of highest score in every group, as (group, *keep, rank).

    Order within a group: score descending, then ``ties`` ascending (nulls first), so the
    result is the same each time as long as the ties are unique in a group. Rows without a
    group, or whose score is null, NaN, infinite or outside [low, high], are ignored. A group
    with fewer rows gives all of them. An empty table gives no rows.

    The rows are written once, partitioned by score band, then the bands are taken from the
    top. In each band every task first cuts each group to its own best ``n`` rows, so that a
    group of any size sends at most ``n`` rows per task into the shuffle; groups already
    filled by higher bands are dropped by an anti-join on the same partitioning; in the band
    where a group fills up, the exact tie ranking settles the last places. The remaining
    rows are one band more than ``shares`` names. The edges only steer the work, so their histogram
    may come from ``histogram_of``, rows of about the same scores that are cheaper to read.
    """
    columns = list(dict.fromkeys([group, *keep, score, *ties]))
    usable = items.where(F.col(group).isNotNull() & valid_score(F.col(score), low, high)).select(*columns)
    counted = items if histogram_of is None else histogram_of
    edges = band_edges(counted.where(valid_score(F.col(score), low, high)).select(score), score, low, high, shares)
    band = F.lit(0)
    for edge in edges:
        band = band + (F.col(score) < edge).cast("int")
    banded = durable(usable.withColumn("__band", band), partition_by=["__band"])
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties])
    picked: list[DataFrame] = []
    filled: DataFrame | None = None
    for b in range(len(edges) + 1):
        rows = banded.where(F.col("__band") == b).drop("__band")
        ranked = rows.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n)
        if filled is None:
            chosen = ranked.withColumn("__held", F.lit(0))
        else:
            open_rows = ranked.join(filled.where(F.col("__held") >= n).select(group), group, "left_anti")
            partly = filled.where(F.col("__held") < n)
            chosen = (
                open_rows.join(partly, group, "left")
                .withColumn("__held", F.coalesce("__held", F.lit(0)))
                .where(F.col("__rn") + F.col("__held") <= n)
            )
        chosen = chosen.select(group, *[c for c in keep if c != group], (F.col("__rn") + F.col("__held")).alias("rank"))
        last = b == len(edges)
        picked.append(chosen if last else durable(chosen))
        if not last:
            so_far = picked[0]
            for more in picked[1:]:
                so_far = so_far.unionByName(more)
            filled = so_far.groupBy(group).agg(F.count("*").alias("__held"))
    result = picked[0]
    for more in picked[1:]:
        result = result.unionByName(more)
    return result


def top_hits(retrieval: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best valid hits of every document_uri as (document_uri, hit_id, rank).

    Of several deliveries of one (document_uri, case_id, content_hash) only the latest counts
    (recorded_at, then hit_id), even if its score is invalid. Null case_id or content_hash
    are values of their own.
    """
    hits = retrieval.select("hit_id", "case_id", "document_uri", "content_hash", "top_score", "recorded_at")
    keys = ["document_uri", "case_id", "content_hash"]
    latest = latest_delivery(hits.where("document_uri is not null"), keys, ["recorded_at", "hit_id"], ["hit_id", "top_score"])
    return top_n_per_group(latest, "document_uri", "top_score", ["content_hash", "case_id"], ["hit_id"], n, histogram_of=hits)
