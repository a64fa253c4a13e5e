"""The most similar vectors of every vector by an adaptive dimension scan of probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.keys import sampled
from corpusmill.scratch import durable, release

#: Mean rows of a list, lists that are searched together as one bucket, rows beyond which a bucket is divided into lists of its own.
LIST_ROWS, BUCKET_LISTS, BLOCK_ROWS = 16, 16, 32_768
#: Rows that a bucket of several lists is meant to have at most, and mean rows of a bucket of the second round.
BUCKET_ROWS, ROUND_ROWS = 8192, 2048
#: The lists are fitted on at most so many rows; every row is then indexed.
SAMPLE_ROWS, SAMPLE_PER_LIST = 262_144, 12
#: Rows of a bucket on which its own lists are fitted, mean rows of these, and how often buckets are divided.
OWN_SAMPLE, OWN_ROWS, LEVELS = 4096, 1024, 4
#: A bucket's own lists that a row living in it, and one only looked up in it, is looked up in.
OWN_PROBES = (3, 2)
#: Rows that one task takes at a time: to divide a bucket, and to look up in one.
TASK_ROWS = 32_768
#: Divided buckets up to which they are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 200_000
#: Lists that a row is looked up in, its own included, and groups of lists that are looked at for them.
PROBES, GROUP_PROBES = 6, 24
#: A row looks for so many times ``k`` rows, since what it finds is also found by the other side, which may rank it higher.
BOTH_SIDES = 3
#: Columns after which partial distances are tested, and the width of the test in standard deviations.
COLUMN_BLOCKS, EPSILON = (16, 32), 2.1


@dataclass
class Lists:
    """Unit centroids in groups of similar ones; ``bucket_of`` joins lists, ``rows`` is the estimated number of rows of each bucket."""

    centroids: np.ndarray
    group_of: np.ndarray
    group_centroids: np.ndarray
    bucket_of: np.ndarray
    rows: np.ndarray

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` lists of highest similarity per row, best first, -1 where there are fewer."""
        probes = min(probes, len(self.centroids))
        parts = [self._nearest(unit[at : at + 16_384], probes) for at in range(0, len(unit), 16_384)]
        return np.concatenate(parts) if parts else np.empty((0, probes), np.int64)

    def _nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        look = min(GROUP_PROBES, len(self.group_centroids))
        near = np.argpartition(-(unit @ self.group_centroids.T), look - 1, axis=1)[:, :look]
        best = np.full((len(unit), probes), -2.0, dtype=np.float32)
        names = np.full((len(unit), probes), -1, dtype=np.int64)
        for group in np.unique(near):
            rows = np.flatnonzero((near == group).any(axis=1))
            own = np.flatnonzero(self.group_of == group)
            if not len(own):
                continue
            scores = np.concatenate([best[rows], unit[rows] @ self.centroids[own].T], axis=1)
            every = np.concatenate([names[rows], np.broadcast_to(own, (len(rows), len(own)))], axis=1)
            top = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
            best[rows] = np.take_along_axis(scores, top, axis=1)
            names[rows] = np.take_along_axis(every, top, axis=1)
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(names, order, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, lists: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Unit means of the rows of each list; a list without rows stays where it was."""
    order = np.argsort(lists, kind="stable")
    found, start = np.unique(lists[order], return_index=True)
    sums = np.add.reduceat(x[order], start, axis=0)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    out = centroids.copy()
    out[found] = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids[found])
    return out


def _cluster(x: np.ndarray, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each unit row and the clusters' centroids."""
    heads = x[rng.choice(len(x), count, replace=False)]
    for _ in range(4):
        heads = _means(x, np.argmax(x @ heads.T, axis=1), heads)
    return np.argmax(x @ heads.T, axis=1), heads


def _groups(centroids: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    return _cluster(centroids, max(1, int(np.sqrt(len(centroids)) / 2)), rng)


def _buckets(centroids: np.ndarray, group_of: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """Similar lists of one group share a bucket of about ``most``."""
    bucket_of, made = np.zeros(len(centroids), dtype=np.int64), 0
    for group in np.unique(group_of):
        own = np.flatnonzero(group_of == group)
        parts, _ = _cluster(centroids[own], -(-len(own) // most), rng)
        bucket_of[own] = made + parts
        made += int(parts.max()) + 1
    return bucket_of


def fit_lists(sample: np.ndarray, rows: int, seed: int, list_rows: int = LIST_ROWS) -> Lists:
    """Spherical k-means in two levels over a bounded sample of unit rows."""
    rng = np.random.default_rng(seed)
    count = int(max(1, min(rows // list_rows, len(sample) // SAMPLE_PER_LIST)))
    one = np.ones(count, dtype=np.int64)
    centroids = sample[rng.choice(len(sample), count, replace=False)].astype(np.float32)
    for _ in range(2):
        lists = Lists(centroids, *_groups(centroids, rng), one, one).nearest(sample, 1)[:, 0]
        centroids = _means(sample, lists, centroids).astype(np.float32)
    group_of, heads = _groups(centroids, rng)
    fitted = Lists(centroids, group_of, heads.astype(np.float32), _buckets(centroids, group_of, rng, max(1, min(BUCKET_LISTS, BUCKET_ROWS * count // max(1, rows)))), one)
    own = np.bincount(fitted.bucket_of[fitted.nearest(sample, 1)[:, 0]], minlength=int(fitted.bucket_of.max()) + 1)
    fitted.rows = np.ceil(own * (rows / max(1, len(sample)))).astype(np.int64)
    return fitted


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, after which leading columns are a fair sample of a distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def scan(queries: np.ndarray, members: np.ndarray, least: float, k: int, ids: np.ndarray, own: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, cosine) of the up to ``k`` best members per query, cosine at least ``least``.

    Both sides are unit rows after the rotation. Distances grow block by block of columns;
    after each block a pair is abandoned if its partial distance is too long, by the test,
    for the final one to be within the limit. The limit is the least cosine's distance, and
    tightens to a query's own ``k``-th best while the members pass by in blocks.
    """
    dim = queries.shape[1]
    cuts = [c for c in COLUMN_BLOCKS if c < dim]
    limit = np.full(len(queries), 2 - 2 * least + 1e-9)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q32, m32 = queries.astype(np.float32), members.astype(np.float32)
    result = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for at in range(0, len(members), 1024):
        m = m32[at : at + 1024]
        first = cuts[0] if cuts else dim
        partial = (q32[:, :first] ** 2).sum(1)[:, None] + (m[:, :first] ** 2).sum(1)[None, :] - 2 * (q32[:, :first] @ m[:, :first].T)
        width = (1 + epsilon / np.sqrt(first)) ** 2 if first < dim else 1.0
        a, b = np.nonzero(partial <= (limit * (first / dim) * width + 1e-5)[:, None])
        distance = partial[a, b]
        for low, high in zip(cuts, [*cuts[1:], dim], strict=True):
            if high == dim:
                break
            distance = distance + ((q32[a, low:high] - m[b, low:high]) ** 2).sum(1)
            stay = distance <= limit[a] * (high / dim) * (1 + epsilon / np.sqrt(high)) ** 2 + 1e-5
            a, b, distance = a[stay], b[stay], distance[stay]
        cosine = np.einsum("ij,ij->i", queries[a], members[at + b])
        stay = (cosine >= least) & (own[a] != ids[at + b])
        held.append((a[stay], at + b[stay], cosine[stay]))
        a, b, cosine = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids[b], -cosine, a))
        a, b, cosine = a[order], b[order], cosine[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) if len(a) else np.empty(0, np.int64)
        full = rank == k - 1
        limit[a[full]] = np.minimum(limit[a[full]], 2 - 2 * cosine[full] + 1e-9)
        stay = rank < k
        result = (a[stay], b[stay], cosine[stay])
        held = [result]
    return result


def usable_vectors(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """(chunk_id, embedding): per content_hash the usable row of smallest chunk_id.

    Usable: the model's name, exactly ``dim`` finite numbers, not all zero. Rows without
    content_hash or chunk_id are none.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = chunks.select("chunk_id", "content_hash", "embedding_model", "embedding").where(
        (F.col("embedding_model") == model) & (F.size("embedding") == dim) & finite & F.exists("embedding", lambda x: x != 0)
    ).where("content_hash is not null and chunk_id is not null")
    first = F.min(F.struct("chunk_id", "embedding")).alias("first")
    return rows.groupBy("content_hash").agg(first).select("first.chunk_id", "first.embedding")


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32).reshape(-1, dim) if len(column) else np.empty((0, dim), np.float32)


def _collected(rows: DataFrame, dim: int) -> np.ndarray:
    """The unit vectors of a bounded frame, by Arrow: four bytes a number on the driver."""
    column = rows.select("embedding").toArrow().column(0).combine_chunks()
    x = np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


_COPIES = "bucket bigint, home boolean, chunk_id bigint, vector binary"


def assign(lists: Lists, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, home) of every row's copies: one in the bucket it lives in, one in each further bucket with a probed list."""
    near = lists.nearest(_unit(x.astype(np.float64)).astype(np.float32), probes)
    buckets = np.where(near >= 0, lists.bucket_of[near], -1)
    out = []
    for place in range(near.shape[1]):
        rows = np.flatnonzero((buckets[:, place] >= 0) & (buckets[:, :place] != buckets[:, place : place + 1]).all(axis=1))
        out.append((rows, buckets[rows, place], np.full(len(rows), place == 0)))
    row, bucket, home = (np.concatenate(o) for o in zip(*out, strict=True))
    return row, bucket, home


def _copies(x: np.ndarray, ids: np.ndarray, row: np.ndarray, bucket: np.ndarray, home: np.ndarray) -> pd.DataFrame:
    raw = np.frombuffer(np.ascontiguousarray(x, np.float32).tobytes(), dtype=f"V{4 * x.shape[1]}")
    return pd.DataFrame({"bucket": bucket, "home": home, "chunk_id": ids[row], "vector": [v.tobytes() for v in raw[row]]})


def _assigner(shared, dim: int, probes: int):
    def assign_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _vectors(batch["embedding"], dim)
            yield _copies(x, batch["chunk_id"].to_numpy(), *assign(shared.value, x, probes))

    return assign_batches


def _stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float32).reshape(-1, dim)


def own_lists(x: np.ndarray, rows: int, seed: int, own_rows: int = OWN_ROWS) -> np.ndarray:
    """Centroids of a bucket's own lists, fitted on a sample of its rows."""
    count = int(max(1, min(-(-rows // own_rows), len(x) // SAMPLE_PER_LIST)))
    unit = _unit(x.astype(np.float64)).astype(np.float32)
    return _cluster(unit, count, np.random.default_rng(seed))[1].astype(np.float32)


def own_assign(centroids: np.ndarray, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, home) of the copies that a bucket's rows send to its own lists."""
    scores = _unit(x.astype(np.float64)).astype(np.float32) @ centroids.T
    look = min(OWN_PROBES[0], len(centroids))
    near = np.argsort(-scores, axis=1, kind="stable")[:, :look]
    out = []
    for place in range(look):
        rows = np.flatnonzero(home) if place >= OWN_PROBES[1] else np.arange(len(x))
        out.append((rows, near[rows, place], home[rows] & (place == 0)))
    row, own, live = (np.concatenate(o) for o in zip(*out, strict=True))
    return row, own, live


def _names(bucket: int, own: np.ndarray) -> np.ndarray:
    """64-bit names of a bucket's own lists; two that fall together would only be searched together."""
    mixed = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(bucket % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).astype(np.int64)


def _fitter(dim: int, seed: int, own_rows: int):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        found = own_lists(_stacked(group["vector"], dim), int(group["own"].iloc[0]), seed, own_rows)
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "centroids": [found.tobytes()]})

    return fit


def _sender(dim: int):
    def send(group: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(cell):
            return group[["bucket", "home", "chunk_id", "vector"]]
        x, centroids = _stacked(group["vector"], dim), np.frombuffer(cell["centroids"].iloc[0], dtype=np.float32).reshape(-1, dim)
        row, own, home = own_assign(centroids, x, group["home"].to_numpy())
        return _copies(x, group["chunk_id"].to_numpy(), row, _names(int(group["bucket"].iloc[0]), own), home)

    return send


def _divide(copies: DataFrame, dim: int, seed: int, block_rows: int, own_rows: int) -> DataFrame:
    """The copies with every bucket of more than ``block_rows`` living rows divided into lists of its own, level by level.

    The lists of a bucket are fitted by one task on a bounded sample of it, all buckets in
    parallel, and its rows are sent on in bounded parts, so that lists grow with the rows and
    the copies a row sends do not.
    """
    done, current = [], copies
    for level in range(LEVELS):
        current = durable(current)
        sizes = current.groupBy("bucket").agg(F.count_if("home").alias("own"), F.count("*").alias("all"))
        large = durable(sizes.where(F.col("own") > block_rows))
        many = large.count()
        if not many:
            break
        large_side = F.broadcast(large) if many <= BROADCAST_BUCKETS else large
        done.append(current.join(F.broadcast(large.select("bucket")) if many <= BROADCAST_BUCKETS else large.select("bucket"), "bucket", "left_anti"))
        parts = F.ceil(F.col("all") / TASK_ROWS).cast("int")
        big = current.join(large_side, "bucket")
        # the lowest hashes of a bucket, about OWN_SAMPLE of them
        limit = (F.least(F.lit(1.0), F.lit(float(OWN_SAMPLE)) / F.col("own")) * F.lit(2.0**62)).cast("bigint")
        sample = big.where(F.col("home") & (F.shiftrightunsigned(F.xxhash64(F.lit(seed + level), "chunk_id"), 2) < limit))

        cells = durable(sample.select("bucket", "own", "vector").groupBy("bucket").applyInPandas(_fitter(dim, seed + level, own_rows), "bucket bigint, centroids binary"))

        left = big.withColumn("part", F.pmod(F.xxhash64("chunk_id"), parts)).select("bucket", "part", "home", "chunk_id", "vector")
        right = cells.join(large, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint"))).alias("part"), "centroids")
        current = left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInPandas(_sender(dim), _COPIES)
    else:
        current = durable(current)
    for more in done:
        current = current.unionByName(more)
    return current


def _in_blocks(copies: DataFrame, block_rows: int, placed: DataFrame | None = None) -> DataFrame:
    """Buckets as (bucket, m, q): members of block m against what is looked up in block q.

    Only a bucket that could not be divided, its rows being too much alike, has several blocks of members.
    ``placed``: the copies' (bucket, home), where these are at hand without the vectors.
    """
    sizes = durable((copies if placed is None else placed).groupBy("bucket").agg(F.count_if("home").alias("own"), F.count("*").alias("all")).where((F.col("own") > block_rows) | (F.col("all") > TASK_ROWS)))
    many = sizes.count()
    plain = [F.lit(0).alias("m"), F.lit(0).alias("q"), F.col("home").alias("member"), F.lit(True).alias("asks")]
    if not many:
        return copies.select("bucket", *plain, "chunk_id", "vector")
    joined = copies.join(F.broadcast(sizes) if many <= BROADCAST_BUCKETS else sizes, "bucket", "left")
    mb = F.coalesce(F.ceil(F.col("own") / block_rows).cast("int"), F.lit(1))
    qb = F.coalesce(F.ceil(F.col("all") / TASK_ROWS).cast("int"), F.lit(1))
    own_m, own_q = F.pmod(F.xxhash64(F.lit(1), "chunk_id"), mb).cast("int"), F.pmod(F.xxhash64(F.lit(2), "chunk_id"), qb).cast("int")
    asks = F.transform(F.sequence(F.lit(0), mb - 1), lambda m: F.struct(m.alias("m"), own_q.alias("q"), (F.col("home") & (m == own_m)).alias("member"), F.lit(True).alias("asks")))
    rest = F.filter(F.sequence(F.lit(0), qb - 1), lambda q: F.col("home") & (q != own_q))
    serves = F.transform(rest, lambda q: F.struct(own_m.alias("m"), q.alias("q"), F.lit(True).alias("member"), F.lit(False).alias("asks")))
    return joined.select("bucket", "chunk_id", "vector", F.explode(F.concat(asks, serves)).alias("b")).select("bucket", "b.*", "chunk_id", "vector")


def _searcher(dim: int, k: int, least: float, turn: np.ndarray):
    def search(group: pd.DataFrame) -> pd.DataFrame:
        turned = lambda x: _unit(x.astype(np.float64)) @ turn
        raw = _stacked(group["vector"], dim)
        ids, member, asks = group["chunk_id"].to_numpy(), group["member"].to_numpy(), np.flatnonzero(group["asks"].to_numpy())
        members, named = turned(raw[member]), ids[member]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in range(0, len(asks), 1024):
            own = asks[at : at + 1024]
            a, b, cosine = scan(turned(raw[own]), members, least, BOTH_SIDES * k, named, ids[own])
            found.append((ids[own[a]], named[b], np.round(cosine, 12)))
        a, b, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b, cosine = np.r_[a, b], np.r_[b, a], np.r_[cosine, cosine]
        order = np.lexsort((b, -cosine, a))
        a, b, cosine = a[order], b[order], cosine[order]
        stay = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b, cosine = a[stay], b[stay], cosine[stay]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        return pd.DataFrame({"chunk_id": a, "other": b, "cosine": cosine})[rank < k]

    return search


_FOUND = "chunk_id bigint, other bigint, cosine double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar of every row among what was found, each once; one shuffle by the row."""
    once = found.repartition("chunk_id").groupBy("chunk_id", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("chunk_id").orderBy(F.col("cosine").desc(), "other")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def _first_round(indexed: DataFrame, rows: int, dim: int, k: int, least: float, probes: int, list_rows: int, seed: int, sample_rows: int, block_rows: int, own_rows: int) -> DataFrame:
    """What the probed lists give: (chunk_id, other, cosine), up to ``k`` of each row."""
    wanted = min(sample_rows, max(4096, SAMPLE_PER_LIST * (rows // list_rows)))
    # no vector is left more than k + 1 times, so a sample by vectors is as bounded as it is meant to be
    sample = _collected(indexed.where(sampled(wanted / rows, seed, "embedding")), dim)
    if len(sample) < 2:
        sample = _collected(indexed.limit(4096), dim)
    lists = fit_lists(sample, rows, seed, list_rows)
    shared = indexed.sparkSession.sparkContext.broadcast(lists)
    copies = indexed.mapInPandas(_assigner(shared, dim, probes), _COPIES)
    if lists.rows.max() > block_rows:
        blocks = _in_blocks(_divide(copies, dim, seed, block_rows, own_rows), block_rows)
    else:
        blocks = copies.select("bucket", F.lit(0).alias("m"), F.lit(0).alias("q"), F.col("home").alias("member"), F.lit(True).alias("asks"), "chunk_id", "vector")
    found = blocks.groupBy("bucket", "m", "q").applyInPandas(_searcher(dim, k, least, rotation(dim, seed)), _FOUND)
    return durable(_best(found, k))


def _second_round(indexed: DataFrame, near: DataFrame, rows: int, dim: int, k: int, least: float, seed: int, block_rows: int) -> DataFrame:
    """What rows find among those that share a label with them, the smallest chunk_id two steps away along ``near``.

    Rows of one neighbourhood that lists kept apart mostly have neighbours in common, and so one label.
    """
    both = near.select("chunk_id", "other").unionByName(near.select(F.col("other").alias("chunk_id"), F.col("chunk_id").alias("other")))
    label = F.least("chunk_id", "other")
    one = durable(both.groupBy("chunk_id").agg(F.min(label).alias("label"))).select(F.col("chunk_id").alias("other"), "label")
    bins = -(-rows // ROUND_ROWS)
    two = both.join(one, "other").groupBy("chunk_id").agg(F.min("label").alias("label"))
    placed = durable(two.select("chunk_id", F.pmod(F.xxhash64(F.lit(seed), "label"), F.lit(bins)).cast("bigint").alias("bucket"), F.lit(True).alias("home")))
    copies = indexed.mapInPandas(_plain(dim), "chunk_id bigint, vector binary").join(placed, "chunk_id")
    blocks = _in_blocks(copies, block_rows, placed)
    return blocks.groupBy("bucket", "m", "q").applyInPandas(_searcher(dim, k, least, rotation(dim, seed)), _FOUND)


def _plain(dim: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = np.arange(len(batch))
            yield _copies(_vectors(batch["embedding"], dim), batch["chunk_id"].to_numpy(), every, every, every >= 0)[["chunk_id", "vector"]]

    return pack


def similar_pairs(
    chunks: DataFrame,
    model: str,
    dim: int,
    k: int = 5,
    least: float = 0.85,
    probes: int = PROBES,
    list_rows: int = LIST_ROWS,
    seed: int = 29,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
    own_rows: int = OWN_ROWS,
) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: either is among the ``k`` most similar of the other.

    Each content_hash is represented by the smallest chunk_id of its usable rows; similarity
    is the cosine, at least ``least``; of equals the smaller chunk_id goes first. Rows whose
    vector is null, of another length, not finite or all zero, and those of another model, are
    ignored. Empty tables give no rows.

    Lists are fitted on a bounded sample, then every row is put into its nearest list and
    looked up in its ``probes`` nearest ones. Similar lists form buckets, each searched as a
    whole by the adaptive dimension scan of ``scan``, so a row travels once to each bucket
    that holds a probed list. Where the sample shows buckets of more than ``block_rows`` rows,
    these are counted and divided into lists of their own, see ``_divide``. What one row finds is
    found by the other too. A list is far wider than a neighbourhood once there are many more rows
    than the sample has, so neighbours are then kept apart: a second round compares all rows that
    reach one smallest chunk_id over the neighbours found so far. Rows sharing one
    vector beyond the first ``k`` + 1 are not indexed: their neighbours are the first ``k`` of
    their vector, exactly.
    """
    reps = durable(usable_vectors(chunks, model, dim))
    spark = reps.sparkSession
    rows = reps.count()
    nothing = reps.select(F.col("chunk_id").alias("chunk_id_a"), F.col("chunk_id").alias("chunk_id_b"))
    if rows < 2:
        return nothing.where("false")
    same = [F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")]
    crowds = durable(reps.groupBy(*same).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h1", "h2"))
    indexed, direct = reps, None
    if not crowds.isEmpty():
        keyed = reps.select("*", *same)
        crowd = keyed.join(crowds, ["h1", "h2"], "left_semi")
        first = crowd.select("h1", "h2", "chunk_id", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("chunk_id")).alias("place")).where(F.col("place") <= k + 1)
        first = durable(first)
        heads = first.where(F.col("place") <= k).groupBy("h1", "h2").agg(F.collect_list("chunk_id").alias("heads"))
        behind = crowd.select("h1", "h2", "chunk_id").join(first.select("chunk_id"), "chunk_id", "left_anti")
        direct = behind.join(heads, ["h1", "h2"]).select(F.explode("heads").alias("chunk_id_a"), F.col("chunk_id").alias("chunk_id_b"))
        indexed = reps.join(behind.select("chunk_id"), "chunk_id", "left_anti")
    near = _first_round(indexed, rows, dim, k, least, probes, list_rows, seed, sample_rows, block_rows, own_rows)
    release(spark)
    top = _best(near.unionByName(_second_round(indexed, near, rows, dim, k, least, seed, block_rows)), k)
    pairs = top.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b"))
    return (pairs.unionByName(direct) if direct is not None else pairs).distinct()
