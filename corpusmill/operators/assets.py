"""Files and images behind documents: keys, public URLs, roots, proofs, and checks of described records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.images import compare_images

_KEY = r"^[A-Za-z0-9][\w.-]*/[\w.()-]+\.(png|jpe?g|webp)$"


def image_key(collection: Column, name: Column) -> Column:
    """``folder/file`` of one image, or null where the two do not name exactly one file in one folder."""
    folder = F.regexp_replace(F.translate(collection, "\\", "/"), "^/+|/+$", "")
    key = F.concat(folder, F.lit("/"), F.translate(name, "\\", "/"))
    single = ~folder.contains("/") & ~F.translate(name, "\\", "/").contains("/") & ~folder.isin("", ".", "..") & ~name.isin("", ".", "..")
    return F.when(single & key.rlike(_KEY), key)


def public_url(path: Column, root: str) -> Column:
    """Where a stored path is public: an absolute URL as it is, ``//`` over https, anything else below the root."""
    quoted = F.replace(F.url_encode(F.regexp_replace(path, "^/+", "")), F.lit("%2F"), F.lit("/"))
    below = F.concat(F.lit(root.rstrip("/") + "/"), F.replace(quoted, F.lit("+"), F.lit("%20")))
    return F.when(path.startswith("//"), F.concat(F.lit("https:"), path)).when(path.rlike("^https?://"), path).otherwise(below)


def media_root(rows: DataFrame, url: str, path: str) -> DataFrame:
    """One row: the root that every (url, stored path) pair implies, null unless they all agree.

    A pair whose URL does not end with its path implies nothing.
    """
    tail = F.regexp_replace(F.col(path), "^/+", "")
    fits = F.col(url).endswith(F.concat(F.lit("/"), tail)) & (tail != "")
    root = F.substring(F.col(url), F.lit(1), F.length(url) - F.length(tail) - 1)
    found = rows.where(fits).agg(F.min(root).alias("low"), F.max(root).alias("high"), F.count("*").alias("pairs"))
    return found.select(F.when(F.col("low") == F.col("high"), F.col("low")).alias("root"), "pairs")


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, proof) of files with one content: equal bytes, or one size and equal visible pixels.

    Both sides: (id, content, digest, width, height). Equal digests join first; only pairs of one
    size whose digests differ are decoded.
    """
    a = left.select(F.col("id").alias("left_id"), F.col("content").alias("ca"), F.col("digest").alias("da"), "width", "height")
    b = right.select(F.col("id").alias("right_id"), F.col("content").alias("cb"), F.col("digest").alias("db"), "width", "height")
    exact = a.join(b.drop("width", "height"), F.col("da") == F.col("db")).select("left_id", "right_id", F.lit("confirmed_exact").alias("proof"))
    sized = a.join(b, ["width", "height"]).where(F.col("da") != F.col("db")).select("left_id", "right_id", compare_images(F.col("ca"), F.col("cb")).alias("proof"))
    return exact.unionByName(sized.where("proof like 'confirmed%'"))


def proven_mappings(mapping: DataFrame, proofs: DataFrame) -> DataFrame:
    """(item, page, status): a mapping is confirmed by a proof of the same item, page and digest; any other stays unresolved.

    ``mapping``: (item, page, digest); ``proofs``: (item, page, digest, status).
    """
    sure = proofs.where("status like 'confirmed%'").select("item", "page", "digest").distinct().withColumn("__ok", F.lit(True))
    joined = mapping.join(sure, ["item", "page", "digest"], "left")
    return joined.select("item", F.when(F.col("__ok"), F.col("page")).alias("page"), F.when(F.col("__ok"), "confirmed").otherwise("unresolved").alias("status"))


def final_mapping(active: DataFrame, matched: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(item, page, verification_status, source): mappings made before, kept whatever their outcome, and new ones that a comparison confirmed.

    ``active``: (item); ``matched``: (item, page); ``outcomes``: (item, status, page), page being that of the proof.
    """
    kept = matched.select("item", F.col("page").alias("__own"))
    found = active.join(outcomes.select("item", "status", F.col("page").alias("__proof")), "item", "left").join(kept, "item", "left")
    rows = found.where(F.col("__own").isNotNull() | F.col("__proof").isNotNull())
    return rows.select("item", F.coalesce("__own", "__proof").alias("page"), F.col("status").alias("verification_status"), F.when(F.col("__own").isNotNull(), "matched").otherwise("proof").alias("source"))


def mapping_problems(
    active: DataFrame, skipped: DataFrame, matched: DataFrame, outcomes: DataFrame, final: DataFrame, public: str, confirmed: Sequence[str], before: DataFrame | None = None, after: DataFrame | None = None
) -> DataFrame:
    """(problem, item) of a final mapping; none means it stands.

    An active item without outcome, an outcome of none, a skipped item that is mapped, a page not
    below ``public``, a mapping made before and lost, a new one without a confirming status, and
    input files, (item, digest) ``before`` and ``after``, that changed meanwhile.
    """
    parts = [
        active.join(outcomes, "item", "left_anti").select(F.lit("no outcome").alias("problem"), "item"),
        outcomes.join(active, "item", "left_anti").select(F.lit("outcome of no active item").alias("problem"), "item"),
        final.join(skipped, "item", "left_semi").select(F.lit("skipped item is mapped").alias("problem"), "item"),
        final.where(~F.coalesce(F.col("page").startswith(public), F.lit(False))).select(F.lit("not a public page").alias("problem"), "item"),
        matched.join(final, "item", "left_anti").select(F.lit("mapping lost").alias("problem"), "item"),
        final.where((F.col("source") == "proof") & ~F.coalesce(F.col("verification_status").isin(*confirmed), F.lit(False))).select(F.lit("mapping without proof").alias("problem"), "item"),
    ]
    if before is not None and after is not None:
        both = before.select("item", F.col("digest").alias("b")).join(after.select("item", F.col("digest").alias("a")), "item", "full_outer")
        parts.append(both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit("input changed").alias("problem"), "item"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def disjoint_problems(states: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that are in none or in several of the states a key should be in exactly one of."""
    every = states[0].select(key)
    for state in states[1:]:
        every = every.unionByName(state.select(key))
    return every.groupBy(key).agg(F.count("*").alias("states")).where("states <> 1")


def record_problems(
    records: DataFrame, key: str, strings: Sequence[str] = (), filled: Sequence[str] = (), choices: dict[str, Sequence[str]] | None = None, positive: Sequence[str] = (), rebuilt: tuple[Column, str] | None = None
) -> DataFrame:
    """(key, problem) of every rule a record breaks: null or blank fields, values outside a list, numbers below one,
    and a text that its parts do not rebuild, white space aside."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} must be a string")) for c in strings]
    rules += [F.when(F.trim(F.coalesce(F.col(c), F.lit("x"))) == "", F.lit(f"{c} must not be empty")) for c in filled]
    rules += [F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.lit(f"unknown {c}")) for c, allowed in (choices or {}).items()]
    rules += [F.when(F.coalesce(F.col(c) < 1, F.lit(True)), F.lit(f"{c} must be positive")) for c in positive]
    if rebuilt:
        flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
        rules.append(F.when(flat(rebuilt[0]) != flat(F.col(rebuilt[1])), F.lit(f"{rebuilt[1]} is not rebuilt")))
    return records.select(key, F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def json_strings(text: Column) -> Column:
    """Every string value of a JSON text, keys left out, in no particular order; native.

    String literals are matched whole, with their escapes, and those followed by a colon are keys;
    escapes are decoded by parsing the literals as a JSON array.
    """
    literal = r'("(?:[^"\\]|\\.)*")(?!\s*:)'
    whole = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', ":"), F.lit(literal), F.lit(1))
    return F.from_json(F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]")), "array<string>")


def gates(values: DataFrame, rules: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """(gate, value, verdict) of one row of measures: PASS from the first bound on, REVIEW from the second, else FAIL.

    A rule is (name, column, pass bound, review bound); where the pass bound is the lower one, less is better.
    """

    def verdict(value: Column, good: float, fair: float) -> Column:
        less = good < fair
        passed, doubtful = (value <= good, value <= fair) if less else (value >= good, value >= fair)
        return F.when(passed, "PASS").when(doubtful, "REVIEW").otherwise("FAIL")

    entries = [F.struct(F.lit(name).alias("gate"), F.col(c).cast("double").alias("value"), verdict(F.col(c), good, fair).alias("verdict")) for name, c, good, fair in rules]
    return values.select(F.explode(F.array(*entries)).alias("g")).select("g.*")


def plan_operators(df: DataFrame) -> dict[str, int]:
    """How often each physical operator stands in a frame's plan."""
    import re
    from collections import Counter

    text = df._jdf.queryExecution().executedPlan().toString()
    return dict(Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.M)))


def replay_differences(stored: DataFrame, recomputed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of either side that the other lacks, copies counted, with ``side`` stored or recomputed."""
    signed = stored.select(*columns, F.lit(1).alias("s")).unionByName(recomputed.select(*columns, F.lit(-1).alias("s")))
    left = signed.groupBy(*columns).agg(F.sum("s").alias("s")).where("s <> 0")
    return left.select(*columns, F.when(F.col("s") > 0, "stored").otherwise("recomputed").alias("side"), F.abs("s").alias("copies"))


def table_kinds(names: DataFrame, name: str, prefixes: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Names with the reason a table is left out of a scan for, or null."""
    reason = F.when(F.lit(False), F.lit(""))
    for p in prefixes:
        reason = reason.when(F.col(name).startswith(p), F.lit(f"prefix {p}"))
    for s in suffixes:
        reason = reason.when(F.col(name).endswith(s), F.lit(f"suffix {s}"))
    return names.withColumn("excluded", reason)


def longest_first(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Per key the row whose ``by`` is the longest, the smaller text of equals."""
    order = Window.partitionBy(key).orderBy(F.length(by).desc(), F.col(by))
    return rows.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


