"""Filling fixed-capacity containers with documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.keys import opened, sealed
from corpusmill.llm.tokens import count_tokens
from corpusmill.scratch import durable

#: Items that one task packs at a time; more items make more groups, never larger ones.
GROUP_ITEMS = 8_192


class Bins:
    """Containers under best-fit placement and swap-based local search; items are (size, key)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.by_free: dict[int, set[int]] = defaultdict(set)
        self.free_mask = 0
        self.next_bin = 0

    def _set_fill(self, b: int, fill: int) -> None:
        if b in self.fill:
            old = self.capacity - self.fill[b]
            self.by_free[old].discard(b)
            if not self.by_free[old]:
                self.free_mask &= ~(1 << old)
        free = self.capacity - fill
        self.fill[b] = fill
        self.by_free[free].add(b)
        self.free_mask |= 1 << free

    def _drop(self, b: int) -> None:
        free = self.capacity - self.fill.pop(b)
        self.by_free[free].discard(b)
        if not self.by_free[free]:
            self.free_mask &= ~(1 << free)
        del self.items[b]

    def tightest(self, size: int, but: int = -1) -> int | None:
        """The bin with the least room that holds ``size``, other than ``but``."""
        mask = self.free_mask >> size
        at = size
        while mask:
            step = (mask & -mask).bit_length() - 1
            at += step
            for b in self.by_free[at]:
                if b != but:
                    return b
            mask >>= step + 1
            at += 1
        return None

    def place(self, index: int, size: int) -> None:
        b = self.tightest(size)
        if b is None:
            b, self.next_bin = self.next_bin, self.next_bin + 1
            self.items[b] = [index]
            self._set_fill(b, size)
        else:
            self.items[b].append(index)
            self._set_fill(b, self.fill[b] + size)


def pack(sizes: list[int], capacity: int, search: bool = True) -> list[int]:
    """A bin number for every item: best fit in decreasing order, then local search unless it is left out.

    The search takes the underfull bins from the emptiest up. Each item, or pair of items, of
    such a bin is moved into another underfull bin or exchanged for a smaller item there, so
    that the fuller bin gains: every step raises the sum of squared fills, so the search ends,
    when no step helps, and a bin that has given everything away is gone. There is nothing to search for once the
    bins are as few as the sum of the sizes allows.
    """
    bins = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins.place(i, sizes[i])
    fewest = -(-sum(sizes) // capacity)
    held = {b: _mask(own, sizes) for b, own in bins.items.items()}
    while search and len(bins.items) > fewest and _improve(bins, sizes, fewest, held):
        pass
    number = {b: n for n, b in enumerate(sorted(bins.items))}
    out = [0] * len(sizes)
    for b, own in bins.items.items():
        for i in own:
            out[i] = number[b]
    return out


def _mask(own: list[int], sizes: list[int]) -> int:
    """The sizes of the items as bits."""
    mask = 0
    for i in own:
        mask |= 1 << sizes[i]
    return mask


def _improve(bins: Bins, sizes: list[int], fewest: int, held: dict[int, int]) -> bool:
    """One pass over the underfull bins as givers; whether any step was made."""
    capacity, stepped = bins.capacity, False
    for giver in sorted((b for b, f in bins.fill.items() if f < capacity), key=lambda b: (bins.fill[b], b)):
        while giver in bins.items and bins.fill[giver] < capacity and len(bins.items) > fewest and _step(bins, sizes, giver, held):
            stepped = True
    return stepped


def _step(bins: Bins, sizes: list[int], giver: int, held: dict[int, int]) -> bool:
    """Move an item, exchange one, or exchange a pair; whether any of these helped."""
    own = sorted(bins.items[giver], key=lambda i: -sizes[i])
    for i in own:
        taker = bins.tightest(sizes[i], giver)
        if taker is not None and bins.fill[taker] + sizes[i] > bins.fill[giver]:
            _transfer(bins, sizes, giver, taker, (i,), None, held)
            return True
    if (found := _exchange(bins, giver, held[giver], held)) is not None:
        taker, size, back = found
        out = (next(i for i in own if sizes[i] == size),)
    else:
        pairs = later = 0
        for i in own:
            pairs |= later << sizes[i]
            later |= 1 << sizes[i]
        if (found := _exchange(bins, giver, pairs, held)) is None:
            return False
        taker, size, back = found
        seen: dict[int, int] = {}
        for i in own:
            if size - sizes[i] in seen:
                out = (seen[size - sizes[i]], i)
                break
            seen[sizes[i]] = i
    _transfer(bins, sizes, giver, taker, out, next(i for i in bins.items[taker] if sizes[i] == back), held)
    return True


def _exchange(bins: Bins, giver: int, offered: int, held: dict[int, int]) -> tuple[int, int, int] | None:
    """(taker, size given, size taken back) of an exchange that helps, for the sizes ``offered`` as bits, or none.

    A taker gains at most its room, so all takers together are tried for as many gains as there is room in all bins.
    """
    fill = bins.fill[giver]
    mask = bins.free_mask & ~1
    while mask:
        room = (mask & -mask).bit_length() - 1
        mask &= mask - 1
        least = max(1, fill - (bins.capacity - room) + 1)
        for gain in range(room, least - 1, -1):
            backs = offered >> gain & ~1
            for taker in bins.by_free[room] if backs else ():
                if taker != giver and (both := backs & held[taker]):
                    back = (both & -both).bit_length() - 1
                    return taker, back + gain, back
    return None


def _transfer(bins: Bins, sizes: list[int], giver: int, taker: int, out: tuple[int, ...], back: int | None, held: dict[int, int]) -> None:
    gain = sum(sizes[i] for i in out) - (sizes[back] if back is not None else 0)
    bins.items[giver] = [i for i in bins.items[giver] if i not in out] + ([back] if back is not None else [])
    bins.items[taker] = [i for i in bins.items[taker] if i != back] + list(out)
    bins._set_fill(taker, bins.fill[taker] + gain)
    bins._set_fill(giver, bins.fill[giver] - gain)
    for b in (giver, taker):
        held[b] = _mask(bins.items[b], sizes)
    if not bins.items[giver]:
        bins._drop(giver)


_PACKED = "doc_id bigint, part_no int, token_start bigint, n_tokens bigint, item bigint, container_id string, fill bigint"


def _pack_group(turn: int, capacity: int, search: bool):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames or not sum(map(len, frames)):
            return
        rows = pd.concat(frames, ignore_index=True).sort_values(["n_tokens", "doc_id", "part_no", "item"], ascending=[False, True, True, True], ignore_index=True)
        bins = pack([int(n) for n in rows["n_tokens"]], capacity, search)
        group = TaskContext.get().partitionId()
        rows["container_id"] = [f"{turn}-{group}-{b}" for b in bins]
        rows["fill"] = rows.groupby("container_id")["n_tokens"].transform("sum")
        yield rows[["doc_id", "part_no", "token_start", "n_tokens", "item", "container_id", "fill"]]

    return packed


def items_of(counted: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part_no, token_start, n_tokens, item) of (doc_id, n_tokens): what is packed, each part of a text with a number of its own."""
    counted = counted.where("n_tokens > 0")
    part = F.explode(F.sequence(F.lit(1), F.ceil(F.col("n_tokens") / capacity).cast("int")))
    parts = counted.select("doc_id", F.col("n_tokens").alias("all_tokens"), part.alias("part_no")).select(
        "doc_id",
        "part_no",
        ((F.col("part_no") - 1) * F.lit(capacity).cast("bigint")).alias("token_start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("all_tokens") - (F.col("part_no") - 1) * F.lit(capacity)).alias("n_tokens"),
        F.monotonically_increasing_id().alias("item"),
    )
    return durable(parts)


def pack_items(items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS, search: bool = True) -> DataFrame:
    """The containers of a durable table of items, see ``fill_containers``; without ``search`` by best fit alone."""
    names = ["doc_id", "part_no", "token_start", "n_tokens", "container_id"]
    # ids of whole containers count the repeated rows of a text apart
    whole = items.where(F.col("n_tokens") == capacity).withColumn("container_id", F.concat_ws("-", F.lit("w"), "doc_id", "part_no", "item"))
    done = [whole.select(*names)]
    todo, turn, before, bins_before = items.where(F.col("n_tokens") < capacity), 0, None, None
    rows = todo.count()
    while rows:
        groups = -(-rows // group_items)
        # by the item's own number, so that rows of one doc_id are dealt like any others
        dealt = todo.repartition(groups, F.xxhash64(F.lit(turn), "item"))
        sent = dealt.select(sealed("doc_id").alias("doc_id"), "part_no", "token_start", "n_tokens", "item")
        packed = durable(sent.mapInPandas(_pack_group(turn, capacity, search), _PACKED).withColumn("doc_id", opened("doc_id")))
        per = packed.groupBy("container_id").agg(F.count("*").alias("rows"), F.max("fill").alias("fill"))
        is_open = F.col("fill") < capacity
        total = lambda c: F.coalesce(F.sum(F.when(is_open, F.col(c))), F.lit(0))
        counts = per.agg(F.count("*").alias("all"), F.count_if(is_open).alias("bins"), total("rows").alias("rows"), total("fill").alias("tokens")).first()
        if before is not None and counts["all"] > bins_before:
            done.append(before)
            break
        if groups == 1 or counts["bins"] <= -(-counts["tokens"] // capacity) or (before is not None and counts["bins"] >= bins_before):
            done.append(packed.select(*names))
            break
        done.append(packed.where(~is_open).select(*names))
        todo, rows, bins_before, turn = packed.where(is_open), counts["rows"], counts["bins"], turn + 1
        before = todo.select(*names)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def fill_containers(documents: DataFrame, capacity: int = 2048, group_items: int = GROUP_ITEMS, **tokenizer: str) -> DataFrame:
    """Every text's tokens in containers: (doc_id, part_no, token_start, n_tokens, container_id).

    A text of at most ``capacity`` tokens is one part, 1. A longer one is cut into parts of
    exactly ``capacity`` tokens, each a full container, and a rest that is packed like any
    other item. Null and empty texts have no tokens and no rows; repeated rows are packed
    each by itself; a null doc_id is kept.

    Items are dealt by hash of their number into groups of about ``group_items``, each packed in
    one task. The bins that stay underfull meet again in fewer, equally bounded groups until one
    group holds them all, they are as few as their tokens allow, or a turn brings their number no
    lower; a group wastes about one bin, so the later turns handle few rows. A turn that needs
    more bins for its rows than the one before is not kept.
    """
    return pack_items(items_of(count_tokens(documents, ["doc_id"], **tokenizer), capacity), capacity, group_items)


def container_fill(documents: DataFrame, capacity: int = 2048, **tokenizer: str) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible and the share of room used."""
    return _fill(fill_containers(documents, capacity, **tokenizer), capacity)


def _fill(packed: DataFrame, capacity: int) -> DataFrame:
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens")).select(
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * capacity), 6)).alias("fill_share"),
    )


def search_gain(documents: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048), **tokenizer: str) -> DataFrame:
    """Per capacity the containers by best fit alone, those after the search, and the least number possible.

    (capacity, best_fit, searched, least_containers, best_fit_share, searched_share)
    """
    rows, counted = None, durable(count_tokens(documents, ["doc_id"], **tokenizer))
    for capacity in capacities:
        items = items_of(counted, capacity)
        plain, searched = (_fill(pack_items(items, capacity, search=search), capacity) for search in (False, True))
        row = plain.select(F.lit(capacity).alias("capacity"), F.col("containers").alias("best_fit"), F.col("fill_share").alias("best_fit_share")).crossJoin(
            searched.select(F.col("containers").alias("searched"), "least_containers", F.col("fill_share").alias("searched_share"))
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows.select("capacity", "best_fit", "searched", "least_containers", "best_fit_share", "searched_share")
