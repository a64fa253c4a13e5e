"""Mixing sources to target weights under a repeat cap."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import count_tokens
from corpusmill.scratch import durable

#: Hash ranges per leaf whose token sums locate the end of a prefix, and rows of the range it ends in beyond which that is ranged anew.
RANGES, SORT_ROWS = 4096, 500_000
#: Domains, and languages, that stand for themselves in the tree; the smaller ones stand together as ``OTHER``.
DOMAINS, LANGUAGES, OTHER = 256, 64, "other"
#: Targets, or leaves of the tree, up to which they are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


@dataclass
class Node:
    """A node of the domain-language-source tree; ``cap`` is the most tokens its leaves can give."""

    name: str
    weight: float = 0.0
    cap: int = 0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def add(self, path: tuple[str, ...], weight: float, cap: int) -> None:
        self.weight += weight
        self.cap += cap
        if path:
            self.children.setdefault(path[0], Node(path[0])).add(path[1:], weight, cap)

    def leaves(self) -> list[Node]:
        return [leaf for child in self.children.values() for leaf in child.leaves()] if self.children else [self]


def share_out(node: Node, budget: float) -> None:
    """Give ``budget`` to the leaves by weight; what a child cannot take goes to its siblings first.

    A child's part is its weight's share; children whose cap is below it take their cap and the
    rest is shared anew among the others. Only what all children of a node cannot take together
    was never given to the node, because its cap limited it one level up.
    """
    node.budget = min(budget, node.cap)
    rest, open_children = node.budget, [c for _, c in sorted(node.children.items())]
    while open_children:
        weights = sum(c.weight for c in open_children)
        part = {c.name: rest * c.weight / weights if weights else rest / len(open_children) for c in open_children}
        short = [c for c in open_children if c.cap < part[c.name]]
        if not short:
            for child in open_children:
                share_out(child, part[child.name])
            return
        for child in short:
            share_out(child, child.cap)
            rest -= child.cap
        open_children = [c for c in open_children if c not in short]


def primary_language(lang):
    """The two-letter code of a language tag, ``und`` where there is none."""
    head = F.lower(F.split(F.trim(lang), "[-_]").getItem(0))
    return F.when(head.isin("eng", "deu", "ger", "fra", "fre", "spa", "por", "ita"), F.element_at(
        F.create_map(*[F.lit(x) for pair in (("eng", "en"), ("deu", "de"), ("ger", "de"), ("fra", "fr"), ("fre", "fr"), ("spa", "es"), ("por", "pt"), ("ita", "it")) for x in pair]), head
    )).when(head.rlike("^[a-z]{2}$"), head).otherwise("und")


def _largest(counted: DataFrame, column: str, most: int) -> list[str]:
    """The values of most tokens; a free-text column may have any number of them."""
    sums = counted.groupBy(column).agg(F.sum("n_tokens").alias("tokens"))
    return [r[column] for r in sums.orderBy(F.col("tokens").desc(), column).limit(most).collect()]


def _plan(sums: list, wanted: dict) -> tuple[list[tuple], list[tuple]]:
    """Budgets of all leaves and of all target sources.

    A leaf is a source within a domain and language; a source's weight is split over its leaves
    by their tokens. What reaches the driver is one row per target and leaf, of bounded number.
    """
    total: dict[str, int] = {}
    for r in sums:
        total[r["source"]] = total.get(r["source"], 0) + r["tokens"]
    scale = sum(w["target_share"] for w in wanted.values()) or 1.0
    repeats = {source: max(0, w["max_repeats"] or 0) for source, w in wanted.items()}
    root = Node("all")
    for r in sorted(sums, key=lambda r: (r["domain"], r["language"], r["source"])):
        source = r["source"]
        weight = wanted[source]["target_share"] / scale * r["tokens"] / total[source]
        root.add((r["domain"], r["language"], source), weight, r["tokens"] * repeats[source])
    share_out(root, sum(total.values()))
    sizes = {(r["domain"], r["language"], r["source"]): r["tokens"] for r in sums}
    leaves, budgets = [], dict.fromkeys(wanted, 0.0)
    for domain, by_language in root.children.items():
        for language, by_source in by_language.children.items():
            for source, leaf in by_source.children.items():
                size, most = sizes[domain, language, source], repeats[source]
                epochs = min(int(leaf.budget // size), most)
                rest = max(0, int(round(leaf.budget)) - epochs * size) if epochs < most else 0
                leaves.append((source, domain, language, size, int(round(leaf.budget)), epochs, rest))
                budgets[source] += leaf.budget
    sources = [(s, float(w["target_share"]), int(w["max_repeats"] or 0), total.get(s, 0), int(round(budgets[s]))) for s, w in sorted(wanted.items())]
    return leaves, sources


def _round_up(ends: list) -> list[tuple]:
    """Per leaf whether the document across its budget's end is taken, so that what a source gives stays nearest to its budget leaf by leaf.

    ``ends`` holds one row a leaf: the tokens wanting without that document, and those over with it.
    """
    off: dict[str, int] = {}
    found = []
    for r in sorted(ends, key=lambda r: (r["source"], r["domain"], r["language"])):
        so_far = off.get(r["source"], 0)
        up = abs(so_far + r["over"]) <= abs(so_far - r["short"])
        off[r["source"]] = so_far + r["over"] if up else so_far - r["short"]
        found.append((r["source"], r["domain"], r["language"], up))
    return found


_LEAVES = "source string, domain string, language string, available bigint, budget bigint, epochs int, rest bigint"
_SOURCES = "source string, target_share double, max_repeats int, available bigint, budget bigint"
_LEAF = ["source", "domain", "language"]


def _few(df: DataFrame) -> DataFrame:
    """A durable or local frame, broadcast only after its rows were counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _select(documents: DataFrame, targets: DataFrame, seed: int, tokenizer: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = documents.sparkSession
    aims = targets.where("source is not null and target_share > 0 and not isnan(target_share)").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: r for r in aims.collect()}
    rows = documents.select("doc_id", "source", "text", F.coalesce("content_type", F.lit("none")).alias("domain"), primary_language(F.col("lang")).alias("language"))
    # a filter that reaches the scan where the sources are few
    rows = rows.where(F.col("source").isin(list(wanted))) if len(wanted) <= 1000 else rows.join(_few(aims.select("source")), "source", "left_semi")
    counted = durable(count_tokens(rows, ["doc_id", "source", "domain", "language"], **tokenizer).where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    placed = counted
    for column, most in (("domain", DOMAINS), ("language", LANGUAGES)):
        names = _largest(counted, column, most)
        placed = placed.withColumn(column, F.when(F.col(column).isin(names), F.col(column)).otherwise(OTHER)) if len(names) == most else placed
    sums = placed.groupBy(*_LEAF).agg(F.sum("n_tokens").alias("tokens")).collect()
    leaf_rows, source_rows = _plan(sums, wanted)
    leaves, plan = spark.createDataFrame(leaf_rows, _LEAVES), spark.createDataFrame(source_rows, _SOURCES)
    hashed = placed.join(_few(leaves.select(*_LEAF, "epochs", "rest")), _LEAF)
    # order within a leaf: by document, rows of one document by themselves
    keys = [F.xxhash64(F.lit(seed), "epochs", "doc_id"), F.xxhash64(F.lit(seed + 1), "row")]
    hashed = hashed.withColumns({"h": keys[0], "g": keys[1]})
    levels = [F.pmod(F.shiftright("h", shift), F.lit(RANGES)) for shift in (52, 40)] + [F.pmod(F.shiftright("g", shift), F.lit(RANGES)) for shift in (52, 40)]
    none = F.lit(0).cast("int")
    open_ = hashed.where("rest > 0").withColumn("left", F.col("rest"))
    done: list[DataFrame] = [hashed.where("rest <= 0").withColumn("extra", none)]
    for level in levels:
        ranged = open_.withColumn("range", level)
        sums_ = ranged.groupBy(*_LEAF, "range", "left").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        upto = F.sum("tokens").over(Window.partitionBy(*_LEAF).orderBy("range"))
        ends = durable(
            sums_.withColumn("upto", upto)
            .withColumn("before", F.col("upto") - F.col("tokens"))
            .where("before < left and upto >= left")
            .select(*_LEAF, F.col("range").alias("end"), (F.col("left") - F.col("before")).alias("more"), "n")
        )
        met = ranged.join(_few(ends), _LEAF, "left")
        done.append(met.where("end is null or range <> end").withColumn("extra", F.coalesce((F.col("range") < F.col("end")).cast("int"), none)))
        open_ = met.where("range = end").withColumn("left", F.col("more")).select(*hashed.columns, "left")
        if (ends.agg(F.max("n")).first()[0] or 0) <= SORT_ROWS:
            break
    running = F.sum("n_tokens").over(Window.partitionBy(*_LEAF).orderBy("h", "g").rowsBetween(Window.unboundedPreceding, 0))
    last = durable(open_.withColumn("running", running))
    crosses = (F.col("running") > F.col("left")) & (F.col("running") - F.col("n_tokens") < F.col("left"))
    ends_at = last.where(crosses).select(*_LEAF, (F.col("left") - F.col("running") + F.col("n_tokens")).alias("short"), (F.col("running") - F.col("left")).alias("over")).collect()
    taken = spark.createDataFrame(_round_up(ends_at), ", ".join(f"{c} string" for c in _LEAF) + ", up boolean")
    joined = last.join(_few(taken), _LEAF, "left")
    done.append(joined.withColumn("extra", F.when(F.col("running") <= F.col("left"), 1).when(crosses & F.col("up"), 1).otherwise(0)))
    columns = ["doc_id", *_LEAF, "n_tokens", (F.col("epochs") + F.col("extra")).alias("copies")]
    chosen = done[0].select(*columns)
    for more in done[1:]:
        chosen = chosen.unionByName(more.select(*columns))
    return chosen.where("copies > 0"), plan, leaves


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 17, **tokenizer: str) -> DataFrame:
    """The mixture as (doc_id, source, n_tokens, copies): each document is used ``copies`` times.

    The total is the token count of all documents whose source has a target. Its parts are
    propagated through a tree of domains (content_type), languages and sources: a source's target
    share is its weight, split over the places where it has tokens in proportion to them. No leaf
    gives more than max_repeats times its tokens; what it cannot give goes to sources of the same
    domain and language first, then of the domain, then to all, by their weights. A leaf's budget
    is spent in whole epochs and the prefix, in seeded hash order, of one more; a prefix ends before or
    behind the document across its end, whichever keeps the source nearest to its budget over the
    leaves so far. Documents without text or source, and
    sources without a positive target, are left out; a target without documents has none to give;
    several targets of one source are added. Repeated rows are documents each by themselves.

    Targets are planned on the driver. The largest domains and languages stand for themselves and
    the rest together, so the leaves are of bounded number. Prefixes are located by token sums
    over hash ranges, the range they end in being ranged anew while it is large, by document and
    then by row, so a task sorts a bounded number of rows however large the source.
    """
    return _select(documents, targets, seed, tokenizer)[0].select("doc_id", "source", "n_tokens", "copies")


def mix_shares(documents: DataFrame, targets: DataFrame, seed: int = 17, **tokenizer: str) -> DataFrame:
    """Per target the share reached: (source, target_share, max_repeats, available, budget, tokens, documents, actual_share)."""
    chosen, plan, _ = _select(documents, targets, seed, tokenizer)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    joined = plan.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    everything = F.sum("tokens").over(Window.partitionBy())
    return joined.select(
        "source", "target_share", "max_repeats", "available", "budget", "tokens", "documents",
        F.when(everything > 0, F.round(F.col("tokens") / everything, 6)).alias("actual_share"),
    )


def mix_leaves(documents: DataFrame, targets: DataFrame, seed: int = 17, **tokenizer: str) -> DataFrame:
    """Per leaf of the tree its budget and what it gave: (domain, language, source, available, budget, epochs, tokens, documents)."""
    chosen, _, leaves = _select(documents, targets, seed, tokenizer)
    got = chosen.groupBy(*_LEAF).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    joined = leaves.join(got, _LEAF, "left")
    return joined.select("domain", "language", "source", "available", "budget", "epochs", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
