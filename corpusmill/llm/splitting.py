"""Cutting oversized items at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.keys import opened, sealed
from corpusmill.llm.html_text import visible_blocks, visible_text

_ENDS = (
    (re.compile(r"\n[ \t]*\n\s*"), 5),
    (re.compile(r"\n\s*"), 4),
    (re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+"), 3),
    (re.compile(r"[;:,]\s+|\s[–—-]\s+"), 2),
    (re.compile(r"\s+"), 1),
)


def boundary_strengths(text: str, ends: dict[int, int] | None = None) -> np.ndarray:
    """Strength of a cut before each offset 0..len: paragraph 5, line 4, sentence 3, clause 2, word 1, else 0.

    ``ends`` adds known ends; the cut is then behind the white space that follows.
    """
    strength = np.zeros(len(text) + 1, dtype=np.int8)
    for pattern, value in reversed(_ENDS):
        at = [m.end() for m in pattern.finditer(text)]
        strength[at] = np.maximum(strength[at], value) if at else 0
    for end, value in (ends or {}).items():
        cut = end + 1 if end < len(text) and text[end] == " " else end
        strength[cut] = max(strength[cut], value)
    return strength


class StrongestCut:
    """Sparse table over boundary strengths: the strongest cut of a window in constant time, the rightmost of equals.

    Levels reach up to the widest window asked for. The table covers a stretch of the text at a
    time and moves on with the windows, so its size is bounded for texts of any length.
    """

    STRETCH = 1 << 18

    def __init__(self, strength: np.ndarray, widest: int):
        self.strength, self.widest = strength, widest
        self._cover(0)

    def _cover(self, base: int) -> None:
        part = self.strength[base : base + max(self.STRETCH, 2 * self.widest)].astype(np.int64)
        self.base, self.n = base, len(part)
        # one number orders by strength, then by position
        self.levels, span = [part * self.n + np.arange(self.n)], 1
        while 2 * span <= min(self.n, self.widest):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-span], below[span:]))
            span *= 2

    def query(self, low: int, high: int) -> int:
        """The best cut in [low, high]; windows must not move back."""
        if high >= self.base + self.n:
            self._cover(low)
        low, high = low - self.base, high - self.base
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return self.base + int(max(level[low], level[high - (1 << k) + 1]) % self.n)


def split_points(text: str, limit: int, overlap: int, least: float = 0.5, ends: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces: each at most ``limit`` long, each starting ``overlap`` before the end of the last.

    The cut is the strongest one that leaves a piece between ``least`` of the limit and the
    limit, the rightmost of equals; the last piece ends with the text.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and larger than the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    shortest = min(limit, max(overlap + 1, int(limit * least)))
    table = StrongestCut(boundary_strengths(text, ends), limit - shortest + 1)
    pieces, start = [], 0
    while n - start > limit:
        end = table.query(start + shortest, start + limit)
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


_PIECES = "item_table string, item_id bigint, piece_no int, start int, end int, content string"


def _splitter(table: str, markup: bool, limit: int, overlap: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["item_id"], batch["body"], strict=True):
                if markup:
                    if len(visible_text(body)) <= limit:
                        continue
                    text, ends = visible_blocks(body)
                else:
                    text, ends = body, None
                if len(text) > limit:
                    rows += [(table, item, no, a, b, text[a:b]) for no, (a, b) in enumerate(split_points(text, limit, overlap, ends=ends), 1)]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "piece_no", "start", "end", "content"])

    return split


def split_items(items: DataFrame, table: str, item_id: str, body: str, limit: int, overlap: int = 150, markup: bool = False) -> DataFrame:
    """Ordered pieces of every item longer than ``limit`` code points.

    Returns (item_table, item_id, piece_no, start, end, content); offsets are code points of
    the item's text, which is the visible text where ``markup`` is set. Consecutive pieces
    share exactly ``overlap`` characters; every character is in a piece. Null and empty
    items, and those within the limit, have no pieces; repeated rows are split each by
    itself; an empty table gives no rows.

    The length test runs before any row reaches Python: decoding never lengthens a text,
    so stored length over the limit is necessary in either case. There is no shuffle.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and larger than the overlap")
    long = items.select(sealed(item_id).alias("item_id"), F.col(body).alias("body")).where(F.length("body") > limit)
    return long.mapInPandas(_splitter(table, markup, limit, overlap), _PIECES).withColumn("item_id", opened("item_id"))


def split_corpus(blog: DataFrame, embeddings: DataFrame, blog_limit: int = 4000, chunk_limit: int = 1000, overlap: int = 150) -> DataFrame:
    """Pieces of oversized blog bodies and chunk contents."""
    return split_items(blog, "blog", "post_id", "html", blog_limit, overlap, markup=True).unionByName(
        split_items(embeddings, "evaluate_embeddings", "chunk_id", "content", chunk_limit, overlap)
    )


def oversized_items(blog: DataFrame, embeddings: DataFrame, **limits: int) -> DataFrame:
    """(item_table, item_id) of the items that were split, taken from their first pieces."""
    return split_corpus(blog, embeddings, **limits).where("piece_no = 1").select("item_table", "item_id")
