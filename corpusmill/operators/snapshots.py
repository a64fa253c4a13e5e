"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.keys import opened, sealed
from corpusmill.functions.urls import DEFAULT_PORTS, respell

def page_key(uri: str | None) -> str | None:
    """The spelling under which a page is compared: see ``compare_snapshots``."""
    if uri is None:
        return None
    rest = uri.strip().partition("#")[0].partition("?")[0]
    rest = respell(rest)
    scheme, mark, after = rest.partition("://")
    if not mark:
        return rest.rstrip("/")
    authority, slash, path = after.partition("/")
    user, at, host = authority.rpartition("@")
    scheme, host = scheme.lower(), host.lower()
    name, colon, port = host.rpartition(":")
    if colon and (not port or port == DEFAULT_PORTS.get(scheme)) and not name.endswith(":"):
        host = name
    return f"{scheme}://{user}{at}{host}{slash}{path}".rstrip("/")


def fold_text(text: str) -> str:
    """NFC with every white-space run as one blank, trimmed."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFC", text)).split())


def _fold_value(value: object) -> object:
    if isinstance(value, str):
        return fold_text(value)
    if isinstance(value, list):
        return [_fold_value(x) for x in value]
    if isinstance(value, dict):
        return {fold_text(k): _fold_value(x) for k, x in value.items()}
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def fold_json(text: str | None) -> str | None:
    """One spelling for equal JSON values; text that is no JSON keeps its folded spelling behind a mark."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return "\x00" + fold_text(text)
    return json.dumps(_fold_value(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _digest(title: str | None, blocks: str | None, lang: str | None, kind: str | None) -> bytes:
    parts = (title and fold_text(title), fold_json(blocks), lang and fold_text(lang), kind and fold_text(kind))
    joined = "\x1f".join("\x00" if p is None else "=" + p for p in parts)
    return hashlib.blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _value(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {
                "run_id": batch["run_id"],
                "next_run": batch["next_run"],
                "has_before": batch["has_before"],
                "canonical_uri": [page_key(_value(u)) for u in batch["canonical_uri"]],
                "retrieved_at": batch["retrieved_at"],
                "record_id": batch["record_id"],
                "content": [
                    _digest(_value(t), _value(b), _value(l), _value(c))
                    for t, b, l, c in zip(batch["title"], batch["blocks"], batch["lang"], batch["content_type"], strict=True)
                ],
            }
        )


def good_runs(runs: DataFrame) -> DataFrame:
    """Good runs with the good run after each one and whether one precedes it.

    Good: run_mode ``sync``, run_status ``succeeded`` and inventory_complete true. Runs
    of one source_scope are ordered by started_at, then run_id. A null in any of these
    columns makes a run not good; a null source_scope is a scope of its own.
    """
    order = Window.partitionBy("source_scope").orderBy("started_at", "run_id")
    return (
        runs.where("run_mode = 'sync' and run_status = 'succeeded' and inventory_complete and run_id is not null")
        .select("run_id", "source_scope", "started_at")
        .select(
            "run_id",
            F.lead("run_id").over(order).alias("next_run"),
            F.lag("run_id").over(order).isNotNull().alias("has_before"),
        )
    )


def multiset_residues(signed: DataFrame, keys: list[str], sign: str = "side") -> DataFrame:
    """EXCEPT ALL both ways in one aggregation.

    ``signed`` holds the rows of the left table with +1 and of the right one with -1 in
    column ``sign``. A row stays as often as its copies outnumber the other side's: a
    positive ``surplus`` is what ``left EXCEPT ALL right`` returns, a negative one what
    ``right EXCEPT ALL left`` returns. This is the plan Spark builds for EXCEPT ALL, but
    one shuffle with map-side sums serves both directions.
    """
    return signed.groupBy(*keys).agg(F.sum(sign).alias("surplus")).where("surplus <> 0")


def compare_snapshots(contract: DataFrame, runs: DataFrame) -> DataFrame:
    """Pages added, removed or changed by each good run against the good run before it.

    Returns (run_id, canonical_uri, change_type), run_id being the later run.

    Pages are compared by trimmed canonical_uri with scheme and host in lower case, no
    default port, query, fragment or trailing slash, percent-escapes of unreserved
    characters decoded and all others in upper case. Of several records of a page in one
    run the one with the latest retrieved_at counts, then the highest record_id (nulls
    lose). Content is title, blocks as JSON values, lang and content_type, with strings in
    NFC and white-space runs as one blank.

    Records without canonical_uri or of a run that is not good are ignored; a null in a
    content column is a value of its own; blocks that are no JSON are compared as text.
    An empty table gives no rows. Other columns are never read.

    Plan: the run ledger meets the records in a join that Spark may broadcast by its
    measured size; each record becomes a key and a 16-byte fingerprint in one Arrow pass;
    the latest record per page and run is a grouped max with map-side combine; identical
    rows vanish in ``multiset_residues``; only the residues meet in the full join.
    """
    ledger = good_runs(runs)
    records = contract.select(
        "run_id", "canonical_uri", "title", "blocks", "lang", "content_type", "retrieved_at", "record_id"
    ).where("canonical_uri is not null")
    paired = records.join(ledger, "run_id").withColumns({"next_run": sealed("next_run"), "record_id": sealed("record_id")})
    keyed = paired.mapInPandas(
        _fingerprints,
        "run_id bigint, next_run bigint, has_before boolean, canonical_uri string, retrieved_at timestamp, record_id bigint, content binary",
    ).withColumn("next_run", opened("next_run"))
    snapshot = keyed.groupBy("run_id", "next_run", "has_before", "canonical_uri").agg(
        F.max(F.struct("retrieved_at", "record_id", "content")).alias("latest")
    )
    sides = F.array(
        F.when(F.col("has_before"), F.struct(F.col("run_id").alias("pair"), F.lit(1).alias("side"))),
        F.when(F.col("next_run").isNotNull(), F.struct(F.col("next_run").alias("pair"), F.lit(-1).alias("side"))),
    )
    signed = snapshot.select("canonical_uri", F.col("latest.content").alias("content"), F.explode(F.array_compact(sides)).alias("s"))
    signed = signed.select("canonical_uri", "content", F.col("s.pair").alias("pair"), F.col("s.side").alias("side"))
    residues = multiset_residues(signed, ["pair", "canonical_uri", "content"])
    now = residues.where("surplus > 0").select("pair", "canonical_uri", F.col("content").alias("new_content"))
    before = residues.where("surplus < 0").select("pair", "canonical_uri", F.col("content").alias("old_content"))
    return now.join(before, ["pair", "canonical_uri"], "full_outer").select(
        F.col("pair").alias("run_id"),
        "canonical_uri",
        F.when(F.col("old_content").isNull(), "added").when(F.col("new_content").isNull(), "removed").otherwise("changed").alias("change_type"),
    )


def change_counts(contract: DataFrame, runs: DataFrame) -> DataFrame:
    """Per good run with one before it: the derived counts beside the recorded ``changed``.

    Runs without any change have zeros; the recorded value is passed through, null included.
    """
    changes = compare_snapshots(contract, runs)
    counts = changes.groupBy("run_id").agg(
        *[F.count_if(F.col("change_type") == kind).alias(f"true_{kind}") for kind in ("added", "removed", "changed")]
    )
    later = good_runs(runs).where("has_before").select("run_id")
    recorded = runs.select("run_id", F.col("changed").alias("recorded_changed"))
    return (
        later.join(recorded, "run_id")
        .join(counts, "run_id", "left")
        .select("run_id", "recorded_changed", *[F.coalesce(f"true_{k}", F.lit(0)).alias(f"true_{k}") for k in ("added", "removed", "changed")])
    )
