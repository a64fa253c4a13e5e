"""Retrieval chunks: character windows, atomic pairs between runs, and heading context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.blocks import BLOCKS, LEAF, render, render_pair
from corpusmill.functions.text import digest, folded_label

CHUNKER_VERSION = 3
SIZE, OVERLAP = 1000, 150
# Alternative texts of images that say nothing.
IDLE_ALTS = ("test", "contact us")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Consecutive windows of ``size`` code points, each ``overlap`` into the last; empty text has none."""
    step = size - overlap
    last = F.when(F.length(text) <= size, 0).otherwise(F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def window_chunks(texts: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, content, content_hash) of every text. No shuffle."""
    return texts.select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_index", "content")).withColumn("content_hash", digest(F.col("content")))


def _idle(block: Column) -> Column:
    return (block["type"] == "image") & folded_label(F.coalesce(block["alt"], F.lit("")), native=True).isin(*IDLE_ALTS)


def chunk_units(blocks: Column) -> Column:
    """Per block ``struct<atomic, text>``: pairs whole, idle images empty, also inside answers."""

    def unit(block: Column) -> Column:
        answer = F.filter(F.coalesce(block["answer"], F.array().cast(f"array<{LEAF}>")), lambda a: ~_idle(a))
        pair = block["type"] == "faq_pair"
        text = F.when(_idle(block), "").when(pair, render_pair(block.withField("answer", answer))).otherwise(render(block))
        return F.struct(pair.alias("atomic"), text.alias("text"))

    return F.transform(F.coalesce(blocks, F.array().cast(BLOCKS)), unit)


def run_texts(units: Column) -> Column:
    """Units folded into ``struct<atomic, text>`` in order: a pair stands alone, what lies between pairs is one text.

    Empty units neither add nor split, but an empty pair still splits. One fold per document
    replaces the window functions over exploded blocks, so documents are chunked without a shuffle.
    """
    kind = "array<struct<atomic:boolean,text:string>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("run"))

    def flush(acc: Column) -> Column:
        run = F.struct(F.lit(False).alias("atomic"), acc["run"].alias("text"))
        return F.when(acc["run"] != "", F.concat(acc["done"], F.array(run))).otherwise(acc["done"])

    def step(acc: Column, unit: Column) -> Column:
        flushed = flush(acc)
        with_pair = F.when(unit["text"] != "", F.concat(flushed, F.array(unit))).otherwise(flushed)
        joined = F.when(acc["run"] == "", unit["text"]).when(unit["text"] == "", acc["run"]).otherwise(F.concat(acc["run"], F.lit("\n\n"), unit["text"]))
        return F.struct(F.when(unit["atomic"], with_pair).otherwise(acc["done"]).alias("done"), F.when(unit["atomic"], "").otherwise(joined).alias("run"))

    return F.aggregate(units, start, step, flush)


def document_chunks(documents: DataFrame, key: str, blocks: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, content, content_hash): pairs whole whatever their length, runs in windows."""
    runs = run_texts(chunk_units(F.col(blocks)))
    chunks = F.flatten(F.transform(runs, lambda r: F.when(r["atomic"], F.array(r["text"])).otherwise(windows(r["text"], size, overlap))))
    return documents.select(key, F.posexplode(chunks).alias("chunk_index", "content")).withColumn("content_hash", digest(F.col("content")))


def heading_paths(blocks: DataFrame, key: str, order: str, level: str, text: str) -> DataFrame:
    """Per row the headings above it: a heading ends those of its own and deeper levels.

    For each level the last heading at or before the row counts if no shallower or equal one came after
    it; that is a window per level over the document's own rows.
    """
    here = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for n in range(1, 7):
        at = F.max(F.when(F.col(level) == n, F.col(order))).over(here)
        ended = F.max(F.when(F.col(level) < n, F.col(order))).over(here)
        name = F.max_by(F.when(F.col(level) == n, F.col(text)), F.when(F.col(level) == n, F.col(order))).over(here)
        out = out.withColumn(f"__h{n}", F.when(at.isNotNull() & (ended.isNull() | (at > ended)), name))
    path = F.array_compact(F.array(*[F.col(f"__h{n}") for n in range(1, 7)]))
    return out.withColumn("heading_path", path).drop(*[f"__h{n}" for n in range(1, 7)])


def contextual_text(title: Column, path: Column, chunk: Column) -> Column:
    """Title and headings other than it, joined by ``›``, a blank line and the chunk."""
    head = F.array_join(F.concat(F.array(title), F.filter(path, lambda h: h != title)), " › ")
    return F.concat(head, F.lit("\n\n"), chunk)


def window_context(chunks: DataFrame, units: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Each window with the heading path of the block it starts in.

    ``units`` holds (key, ord, text, heading_path) of one run's blocks; a block starts behind the
    texts before it and their two-character joints. The last block starting at or before a window
    is found by one sort-based pass over both, not by a range join.
    """
    order = Window.partitionBy(key).orderBy("ord")
    start = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = units.select(key, start.alias("at"), F.lit(0).alias("side"), F.col("heading_path").alias("path"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("content"))
    asked = chunks.select(key, (F.col("chunk_index") * (size - overlap)).cast("bigint").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("array<string>").alias("path"), "chunk_index", "content")
    along = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("path", F.last("path", ignorenulls=True).over(along))
    return both.where("side = 1").select(key, "chunk_index", "content", F.col("path").alias("heading_path"))


def slot_pairs(rows: DataFrame, key: str, slots: list[tuple[str, str]]) -> DataFrame:
    """(key, slot, question, answer) of the filled slots of fixed question and answer columns; half pairs are left out."""
    pairs = F.array(*[F.struct(F.col(q).alias("question"), F.col(a).alias("answer")) for q, a in slots])
    flat = rows.select(key, F.posexplode(pairs).alias("at", "p")).select(key, (F.col("at") + 1).alias("slot"), "p.question", "p.answer")
    return flat.where("trim(coalesce(question, '')) <> '' and trim(coalesce(answer, '')) <> ''")
