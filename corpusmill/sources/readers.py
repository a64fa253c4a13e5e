"""Readers: relational tables, JSON datasets, JSON lines with their problems, dictionaries, files and vectors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- relational --------------------------------------------------------------------------


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    published: str | None = None,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table's declared columns over JDBC in a read-only session; the filter runs at the source.

    With ``key`` and ``bounds`` the read is split into ``partitions`` ranges of a numeric key.
    """
    options = {"url": url, "dbtable": table, "sessionInitStatement": "SET SESSION TRANSACTION READ ONLY", "fetchsize": "1000", "pushDownPredicate": "true"}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    df = spark.read.format("jdbc").options(**options, **(properties or {})).load().select(*columns)
    return df.where(published) if published else df


def read_declared(spark: SparkSession, path: str, schema: T.StructType, published: str | None = None, format: str = "parquet") -> DataFrame:
    """Files under an allow-listed schema: nothing but its columns is ever read."""
    df = spark.read.schema(schema).format(format).load(path)
    return df.where(published) if published else df


# --- JSON --------------------------------------------------------------------------------


def read_json_dataset(spark: SparkSession, path: str, version: int, items: str, item_schema: T.StructType, required: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The items of a versioned JSON document, checked: version, at least one item, required strings.

    ``carry`` names fields of the document that are added to each item. What is wrong is an error
    that names a rule and never content.
    """
    fields = [T.StructField("version", T.IntegerType()), T.StructField(items, T.ArrayType(item_schema)), *[T.StructField(c, T.StringType()) for c in carry]]
    document = spark.read.schema(T.StructType(fields)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not document.where(F.col("version").isNull() | (F.col("version") != version)).isEmpty():
        raise ValueError(f"the dataset must declare version {version}")
    rows = document.select(F.posexplode(items).alias("position", "item"), *carry).select("position", "item.*", *carry)
    if rows.isEmpty():
        raise ValueError("the dataset holds no items")
    for name in required:
        if not rows.where(F.coalesce(F.col(name), F.lit("")) == "").isEmpty():
            raise ValueError(f"{name} must be a non-empty string")
    return rows


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records and problems (line, problem) of a JSON-lines file; blank lines are neither.

    A line that is no JSON object under the schema is a problem and does not stop the read.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.trim("value").startswith("{")
    problems = parsed.where(broken).select(F.col("value").alias("line"), F.when(F.trim("value").startswith("{"), "not valid JSON").otherwise("not a JSON object").alias("problem"))
    return parsed.where(~broken).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), problems


# --- dictionaries in script files ----------------------------------------------------------

_LEXEMES = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<mark>[{}\[\]:,])|(?P<double>\"(?:[^\"\\]|\\.)*\")|(?P<single>'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*|\d+)", re.S
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.S)
_KNOWN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "\n": "", '"': '"', "'": "'", "\\": "\\", "/": "/"}


def _unquote(lexeme: str) -> str:
    def one(match: re.Match[str]) -> str:
        code = match[1]
        if len(code) == 5:
            return chr(int(code[1:], 16))
        if code not in _KNOWN:
            raise ValueError(f"unknown escape \\{code}")
        return _KNOWN[code]

    return _ESCAPE.sub(one, lexeme[1:-1])


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key is repeated")
    return found


def parse_dictionary(source: str, name: str) -> dict[str, list[dict[str, str]]]:
    """The pairs of ``export const <name> = { key: [{question, answer}, ...] }`` in a script file.

    The literal is rewritten as JSON lexeme by lexeme, comments and trailing commas dropped, and the
    JSON decoder does the parsing. Strings in either quotes, bare keys and the usual escapes are
    known; repeated keys and pairs with any other fields are errors.
    """
    found = re.search(rf"export\s+const\s+{re.escape(name)}\b[^=]*=", source)
    if not found:
        raise ValueError(f"no export of {name}")
    out: list[str] = []
    depth, at = 0, found.end()
    while True:
        lexeme = _LEXEMES.match(source, at)
        if not lexeme:
            raise ValueError(f"line {source.count(chr(10), 0, at) + 1}: not understood")
        at, kind, text = lexeme.end(), lexeme.lastgroup, lexeme[0]
        if kind == "skip":
            continue
        if kind == "mark":
            if text in "}]" and out and out[-1] == ",":
                out.pop()
            out.append(text)
            depth += (text in "{[") - (text in "}]")
            if not depth:
                break
        else:
            out.append(json.dumps(text if kind == "name" else _unquote(text)))
    entries = json.loads("".join(out), object_pairs_hook=_unique)
    for pairs in entries.values():
        if not isinstance(pairs, list) or any(not isinstance(p, dict) or set(p) != {"question", "answer"} or not all(isinstance(x, str) for x in p.values()) for p in pairs):
            raise ValueError("a pair has exactly the fields question and answer")
    return entries


def read_dictionaries(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(path, dictionary, position, key, pairs) of the named exports of script files, files read whole."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (file, name, position, key, pairs)
                for file, text in zip(batch["path"], batch["value"], strict=True)
                for name in names
                if re.search(rf"export\s+const\s+{re.escape(name)}\b", text)
                for position, (key, pairs) in enumerate(parse_dictionary(text, name).items())
            ]
            yield pd.DataFrame(rows, columns=["path", "dictionary", "position", "key", "pairs"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(parse, "path string, dictionary string, position int, key string, pairs array<struct<question:string,answer:string>>")


# --- files and vectors ---------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 25 << 20) -> tuple[DataFrame, DataFrame]:
    """Files as (path, content, length, digest), and those over the size as (path, length, problem), whose content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    kept = files.where(F.col("length") <= most_bytes).select("path", "content", "length", F.sha2("content", 256).alias("digest"))
    return kept, files.where(F.col("length") > most_bytes).select("path", "length", F.lit("too large").alias("problem"))


def object_requests(urls: DataFrame, column: str) -> DataFrame:
    """(url, cache_name, problem) of the distinct URLs to fetch: the name under which each is kept, and why one is not fetched."""
    one = urls.select(F.trim(column).alias("url")).where("url <> ''").distinct()
    suffix = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)", 1))
    name = F.concat(F.sha2("url", 256), F.when(suffix != "", F.concat(F.lit("."), suffix)).otherwise(""))
    return one.select("url", name.alias("cache_name"), F.when(~F.lower("url").startswith("https://"), "not https").alias("problem"))


def vector_store_problems(store: DataFrame, manifest: dict[str, object], model: str, dim: int) -> DataFrame:
    """(problem, n) of a vector store: another model or dimension in its manifest, fewer vectors than it says, vectors cut short, repeated keys."""
    said = [("model", 1)] * (manifest.get("model") != model) + [("dimension", 1)] * (manifest.get("dimensions") != dim)
    found = store.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding") != dim, F.lit(True))).alias("cut"), (F.count("*") - F.count_distinct("content_hash")).alias("repeated")).first()
    short = int(manifest.get("vectors", found["n"])) - found["n"]
    rows = [*said, ("truncated store", short), ("vector length", found["cut"]), ("repeated key", found["repeated"])]
    return store.sparkSession.createDataFrame([r for r in rows if r[1] > 0], "problem string, n bigint")


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(content_hash, embedding) of a vector store, refusing vectors of another dimension."""
    store = spark.read.schema("content_hash string, embedding array<float>").parquet(path)
    return store.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("a stored vector has another dimension"))))


def first_found(key: Column, stores: Sequence[DataFrame], rows: DataFrame) -> DataFrame:
    """``rows`` with the vector of the first store that holds their key; no vector is an error left to the caller."""
    out = rows.withColumn("__key", key)
    for at, store in enumerate(stores):
        out = out.join(store.select(F.col("content_hash").alias("__key"), F.col("embedding").alias(f"__v{at}")), "__key", "left")
    return out.withColumn("embedding", F.coalesce(*[F.col(f"__v{at}") for at in range(len(stores))])).drop("__key", *[f"__v{at}" for at in range(len(stores))])


def active_items(manifest: DataFrame, expected: int | None = None) -> DataFrame:
    """(name, value) of a manifest's map column ``items`` without those marked ``skip``; their number may be required."""
    rows = manifest.select(F.explode("items").alias("name", "value")).where(F.lower(F.trim("value")) != "skip")
    if expected is not None and rows.count() != expected:
        raise ValueError("the manifest holds another number of active items")
    return rows
