"""Lines repeated across the documents of one site."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.keys import opened, sealed
from corpusmill.llm.html_text import visible_text
from corpusmill.scratch import durable

_DIGITS = re.compile(r"[0-9]+")
#: Leading tokens that are inner nodes of the token tree below the node for the token count.
TREE_DEPTH = 2
#: Two lines of one leaf share a template if at least so much of their tokens is equal; the others are slots.
ALIKE = 2 / 3
#: Templates after which a task hands on what it has; leaves are never split, so this bounds memory alone.
TREE_TEMPLATES = 200_000
#: Rows of frequent leaves, templates or keys up to which they are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Lines of a leaf for each task that matches them, where templates are too many to be sent to every task.
LEAF_LINES = 100_000

Template = tuple[str | None, ...]


def line_key(line: str) -> str:
    """What two lines must share to be the same: visible text without case, the digits 0-9 and surplus blanks."""
    return " ".join(_DIGITS.sub("", visible_text(line).lower()).split())


def leaf_of(tokens: list[str], depth: int = TREE_DEPTH) -> int:
    """The leaf a line reaches: its site's tree branches by token count, then by the leading tokens."""
    path = f"{len(tokens)}\x1f" + "\x1f".join(tokens[:depth])
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def key_hash(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def grow(templates: list[Template], tokens: Sequence[str | None], among: Iterable[int] | None = None) -> int:
    """Take a line, or another tree's template, into the templates of a leaf; the place of its template.

    The template most alike, of those ``among`` which all alike enough are, gets slots where the two differ; if none is alike
    enough there is one more.
    """
    best, most = -1, ALIKE * len(tokens) - 1e-9
    for at in range(len(templates)) if among is None else among:
        equal = sum(a is not None and a == b for a, b in zip(templates[at], tokens, strict=True))
        if equal >= most and (best < 0 or equal > most):
            best, most = at, equal
    if best < 0:
        best = len(templates)
        templates.append(tuple(tokens))
    else:
        templates[best] = tuple(a if a == b else None for a, b in zip(templates[best], tokens, strict=True))
    return best


def matching(templates: list[Template], tokens: Sequence[str], among: Iterable[int] | None = None) -> int:
    """The template of a leaf whose fixed tokens the line has, of several the one with most of them; -1 if there is none.

    Every line that templates were grown from has one, since merging makes slots only.
    """
    best, most = -1, -1
    for at in range(len(templates)) if among is None else among:
        fixed = sum(a is not None for a in templates[at])
        if fixed > most and all(a is None or a == b for a, b in zip(templates[at], tokens, strict=True)):
            best, most = at, fixed
    return best


class Leaf:
    """The templates of a leaf, found by their fixed tokens, so that a line is compared with few of them however many there are."""

    def __init__(self, templates: Iterable[Template] = ()):
        self.templates: list[Template] = []
        self.fixed: dict[tuple[int, str], set[int]] = {}
        for template in templates:
            self.add(template)

    def add(self, template: Template) -> None:
        self.templates.append(template)
        self._enter(len(self.templates) - 1)

    def _enter(self, at: int) -> None:
        for place in enumerate(self.templates[at]):
            if place[1] is not None:
                self.fixed.setdefault(place, set()).add(at)

    def _near(self, tokens: Sequence[str]) -> list[int]:
        """All templates that share ``ALIKE`` of the tokens: of any places two more than it may miss, each has the tokens of two.

        No template has fewer fixed tokens, so all that a line fits are among them.
        """
        need = math.ceil(ALIKE * len(tokens) - 1e-9)
        rarest = sorted((self.fixed.get(place, set()) for place in enumerate(tokens)), key=len)[: len(tokens) - need + min(2, need)]
        once, twice = set(rarest[0]), set(rarest[0]) if need < 2 else set()
        for own in rarest[1:]:
            twice |= once & own
            if own is not rarest[-1]:
                once |= own
        return sorted(twice)

    def grow(self, tokens: Sequence[str]) -> None:
        near = self._near(tokens)
        before = {at: self.templates[at] for at in near}
        at = grow(self.templates, tokens, near)
        for place, token in enumerate(before.get(at, ())):
            if token is not None and self.templates[at][place] is None:
                self.fixed[place, token].discard(at)
        if at not in before:
            self._enter(at)

    def matching(self, tokens: Sequence[str]) -> int:
        return matching(self.templates, tokens, self._near(tokens))


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


_LINES = "site string, post bigint, post_id bigint, line_no array<int>, leaf array<bigint>, key array<binary>, first array<boolean>, first_leaf array<boolean>, line array<string>"


def _parse_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per post: arrays of its lines' numbers, leaves, keys, first-in-post marks and keys as text, lines without text left out."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for body in batch["html"]:
            own: list[list] = [[] for _ in range(6)]
            seen, reached = set(), set()
            for no, line in enumerate(_text(body).split("\n"), 1):
                key = line_key(line)
                if key:
                    leaf = leaf_of(key.split(" "))
                    for values, value in zip(own, (no, leaf, key_hash(key), key not in seen, leaf not in reached, key), strict=True):
                        values.append(value)
                    seen.add(key)
                    reached.add(leaf)
            for column, values in zip(columns, own, strict=True):
                column.append(values)
        names = ("line_no", "leaf", "key", "first", "first_leaf", "line")
        yield pd.DataFrame({"site": batch["site"], "post": batch["post"], "post_id": batch["post_id"], **dict(zip(names, columns, strict=True))})


_TREES = "site string, leaf bigint, template int, tokens array<string>"


def _grow_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The templates of every leaf, whose lines come one after another in their order."""
    now, leaf = None, Leaf()
    out: list[tuple[str, int, int, list[str | None]]] = []

    def close() -> None:
        found = sorted(set(leaf.templates), key=lambda t: [x or "" for x in t])
        out.extend((*now, n, list(t)) for n, t in enumerate(found))

    def given_on() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["site", "leaf", "template", "tokens"])
        out.clear()
        return rows

    for batch in batches:
        for site, number, line in zip(batch["site"], batch["leaf"], batch["line"], strict=True):
            if (site, number) != now:
                if now is not None:
                    close()
                    if len(out) >= TREE_TEMPLATES:
                        yield given_on()
                now, leaf = (site, number), Leaf()
            leaf.grow(line.split(" "))
    if now is not None:
        close()
        yield given_on()


_MATCHED = "site string, post bigint, post_id bigint, line_no int, leaf bigint, key binary, first boolean, least int, template int, first_template boolean"


def _match(shared):
    """Every line's template and whether it is the first line of its post with that template, among those that pass by together.

    Without ``shared`` templates, those of a leaf come as rows before its lines.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], Leaf] = {}
        post, seen, now, leaf = None, set(), None, Leaf()
        for batch in batches:
            numbers, firsts, cache, lines = [], [], {}, [True] * len(batch)
            sent = batch["tokens"] if shared is None else [None] * len(batch)
            part = batch["part"] if shared is None else [0] * len(batch)
            for n, (site, number, own, line, tokens, among) in enumerate(zip(batch["site"], batch["leaf"], batch["post"], batch["line"], sent, part, strict=True)):
                if (site, number, among) != now:
                    now = (site, number, among)
                    leaf = known.get(now[:2]) if shared is not None else Leaf()
                    if leaf is None:
                        leaf = known[now[:2]] = Leaf(shared.value[now[:2]])
                if tokens is not None:
                    leaf.add(tuple(tokens))
                    lines[n] = False
                    continue
                at = cache.get((site, line))
                if at is None:
                    at = cache[site, line] = leaf.matching(line.split(" "))
                if own != post:
                    post = own
                    seen.clear()
                numbers.append(at)
                firsts.append((number, at) not in seen)
                seen.add((number, at))
            yield batch[lines].drop(columns=["line", "tokens", "part"], errors="ignore").assign(template=numbers, first_template=firsts)

    return match


def _posts_of_sites(blog: DataFrame, min_posts: int, min_share: float) -> DataFrame:
    """Per site the least number of posts that makes a line repeated; posts without html count."""
    total = F.count("*")
    least = F.greatest(F.lit(min_posts), F.ceil(total * F.lit(min_share) - F.lit(1e-9)).cast("int"))
    return blog.groupBy("site").agg(least.alias("least"))


def _join_few(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Join a durable table that is broadcast only after its rows were counted."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on)


def _posts(blog: DataFrame, *more: str) -> DataFrame:
    """(site, post, post_id, html): every row is a post, told apart by ``post`` whatever its post_id."""
    return blog.select(F.coalesce("site", F.lit("")).alias("site"), F.monotonically_increasing_id().alias("post"), "post_id", "html", *more)


def _with_templates(candidates: DataFrame, trees: DataFrame) -> DataFrame:
    """Lines behind the templates of their leaf. A leaf of many lines comes in parts by post, each with all its templates.

    There are at most so many parts that templates do not outnumber lines.
    """
    lines = candidates.groupBy("site", "leaf").agg(F.count("*").alias("lines"))
    sizes = trees.groupBy("site", "leaf").agg(F.count("*").alias("templates")).join(lines, ["site", "leaf"])
    parts = F.floor(F.col("lines") / F.greatest(F.lit(LEAF_LINES), "templates")) + 1
    parts = durable(sizes.select("site", "leaf", parts.cast("int").alias("parts")))
    rows = _join_few(candidates, parts, ["site", "leaf"]).withColumn("part", F.pmod(F.xxhash64("post"), F.col("parts")).cast("int"))
    rows = rows.withColumn("tokens", F.lit(None).cast("array<string>")).withColumn("template", F.lit(-1)).drop("parts")
    first = _join_few(trees, parts, ["site", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = {"post": F.lit(0).cast("bigint"), "post_id": F.lit(0).cast("bigint"), "line_no": F.lit(0), "key": F.lit(b""), "first": F.lit(False), "least": F.lit(0), "line": F.lit("")}
    both = rows.unionByName(first.withColumns(none).drop("parts"))
    ordered = both.repartition("site", "leaf", "part").sortWithinPartitions("site", "leaf", "part", F.col("tokens").isNull(), "template", "post")
    return ordered.drop("template")


def matched_lines(posts: DataFrame, min_posts: int = 5, min_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The lines of frequent templates, and those templates as (site, leaf, template, tokens).

    Lines are parsed once. The templates of a leaf are grown from its different lines in their order, so they depend on these alone,
    neither on partitions nor on any size. A leaf is reached by at least as many posts as any line below it, and each line has one
    template, so neither step loses a repeated line.
    """
    spark = posts.sparkSession
    least = durable(_posts_of_sites(posts, min_posts, min_share))
    parsed = posts.where("html is not null").withColumn("post_id", sealed("post_id")).mapInPandas(_parse_lines, _LINES).withColumn("post_id", opened("post_id"))
    zipped = F.arrays_zip("line_no", "leaf", "key", "first", "first_leaf", "line")
    lines = durable(parsed.select("site", "post", "post_id", F.explode(zipped).alias("l")).select("site", "post", "post_id", "l.*"))
    reach = lines.groupBy("site", "leaf").agg(F.count_if("first_leaf").alias("posts"))
    leaves = durable(_join_few(reach, least, ["site"]).where("posts >= least").select("site", "leaf", "least"))
    columns = ["site", "post", "post_id", "line_no", "leaf", "key", "first", "least", "line"]
    candidates = _join_few(lines, leaves, ["site", "leaf"]).select(*columns)
    different = candidates.select("site", "leaf", "line").distinct().repartition("site", "leaf").sortWithinPartitions("site", "leaf", "line")
    trees = durable(different.mapInPandas(_grow_leaves, _TREES))
    shared = None
    if trees.count() <= BROADCAST_ROWS:
        known: dict[tuple[str, int], list[Template]] = {}
        for r in sorted(trees.collect(), key=lambda r: r["template"]):
            known.setdefault((r["site"], r["leaf"]), []).append(tuple(r["tokens"]))
        shared = spark.sparkContext.broadcast(known)
        sent = candidates.withColumn("post_id", sealed("post_id"))
    else:
        sent = _with_templates(candidates.withColumn("post_id", sealed("post_id")), trees)
    matched = durable(sent.mapInPandas(_match(shared), _MATCHED).withColumn("post_id", opened("post_id")))
    # a post that two tasks share counts twice here: never too few
    cover = matched.groupBy("site", "leaf", "template", "least").agg(F.count_if("first_template").alias("posts"))
    frequent = durable(cover.where("posts >= least").select("site", "leaf", "template"))
    found = _join_few(matched, frequent, ["site", "leaf", "template"])
    return found, trees


def _repeated(posts: DataFrame, min_posts: int, min_share: float) -> DataFrame:
    lines, _ = matched_lines(posts, min_posts, min_share)
    counts = lines.where("first").groupBy("site", "key", "least").agg(F.count("*").alias("posts")).where("posts >= least").select("site", "key")
    return _join_few(lines, durable(counts), ["site", "key"])


def repeated_lines(blog: DataFrame, min_posts: int = 5, min_share: float = 0.1) -> DataFrame:
    """(post_id, line_no) of every line whose text is repeated excessively within its site.

    Lines are html split at ``\\n``, numbered from 1. Two are the same if their visible texts
    are, ignoring case, the digits 0-9 and surplus blanks. A line is repeated if its text is in
    at least ``min_posts`` posts of the site and in ``min_share`` of all the site's posts, those
    without html included. Lines without text are no cases; posts without html have no lines; a
    null site is one site of its own; an empty table gives no rows. Each row of the table is a
    post, also where a post_id repeats.

    Each site has a token tree of fixed depth: by token count, then by leading tokens; below a
    leaf stand templates, whose tokens are slots where their lines differ. Lines are told apart in
    each partition and meet leaf by leaf. Lines are matched with the merged templates, and those of templates that
    cover enough posts are counted one by one, so that only equal lines make a case. All counts
    are summed before the shuffle, whatever the share of one site. The frequent leaves of a
    site are at most 1/``min_share`` times its mean number of lines per post; leaves, templates
    and keys are counted before they are broadcast.
    """
    return _repeated(_posts(blog), min_posts, min_share).select("post_id", "line_no")


def repeated_templates(blog: DataFrame, min_posts: int = 5, min_share: float = 0.1) -> DataFrame:
    """(site, template, posts): the templates that cover so many posts, slots shown as ``<*>``, and how many it is."""
    lines, shown = matched_lines(_posts(blog), min_posts, min_share)
    cover = lines.groupBy("site", "leaf", "template", "least").agg(F.count_distinct("post").alias("posts")).where("posts >= least")
    text = F.array_join(F.transform("tokens", lambda t: F.coalesce(t, F.lit("<*>"))), " ")
    return cover.join(shown, ["site", "leaf", "template"]).select("site", text.alias("template"), "posts")


def _without_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bodies = []
        for body, drop in zip(batch["html"], batch["drop"], strict=True):
            gone = set(drop) if drop is not None else set()
            bodies.append("\n".join(x for no, x in enumerate(body.split("\n"), 1) if no not in gone) if isinstance(body, str) else None)
        yield batch[["post_id", "site", "n_removed"]].assign(html=bodies)


def without_repeated_lines(blog: DataFrame, min_posts: int = 5, min_share: float = 0.1) -> DataFrame:
    """Every post as (post_id, site, n_removed, html), its repeated lines removed; null html stays null.

    Every row loses its own repeated lines and no other, also where a post_id repeats or is null.
    """
    posts = durable(_posts(blog.withColumn("own_site", F.col("site")), "own_site"))
    gone = _repeated(posts.drop("own_site"), min_posts, min_share).groupBy("post").agg(F.collect_set("line_no").alias("drop"))
    joined = posts.join(gone, "post", "left").withColumn("n_removed", F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")))
    sent = joined.select(sealed("post_id").alias("post_id"), F.col("own_site").alias("site"), "n_removed", "html", "drop")
    return sent.mapInPandas(_without_lines, "post_id bigint, site string, n_removed int, html string").withColumn("post_id", opened("post_id"))
