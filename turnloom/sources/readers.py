"""Files into tables.  Schemas are given where they are known, which saves a pass over the data."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.text import strip

CONVERSATIONS = T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))
SHAREGPT = T.StructType([T.StructField("conversations", CONVERSATIONS), T.StructField("tools", T.StringType())])
PREFERENCE = T.StructType([T.StructField("conversations", CONVERSATIONS), T.StructField("tools", T.StringType()), T.StructField("chosen", T.StringType()), T.StructField("rejected", T.StringType())])
QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
TEXT = T.StructType([T.StructField("text", T.StringType())])


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")


def read_jsonl(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All ``*.jsonl`` files under a folder."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    return (r.schema(schema) if schema else r).json(folder)


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.option("multiLine", True).json(path)


def read_aligned(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several JSON files as one table by name of the columns, in the order in which they are first seen; missing ones are
    null.  All files are read, and their types agreed on, in one go."""
    rows = spark.read.json(paths)
    seen = [c for p in paths for c in _first_keys(spark, p)]
    return rows.select(*dict.fromkeys([*(c for c in seen if c in rows.columns), *rows.columns]))


def _first_keys(spark: SparkSession, path: str) -> list[str]:
    """Columns as the first record has them (inference sorts them by name)."""
    first = spark.read.text(path).where(strip(F.col("value")) != "").select(F.json_object_keys("value").alias("k")).first()
    return list(first.k) if first and first.k else []


def read_text(spark: SparkSession, folder: str, linebreaks: bool = False) -> DataFrame:
    """``text``, a row for each line of all ``*.txt`` files under a folder; blank lines stay."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    return rows.select((F.concat("value", F.lit("\n")) if linebreaks else F.col("value")).alias("text"))


def read_corpus(spark: SparkSession, folder: str, linebreaks: bool = False) -> DataFrame:
    """``text`` of all text or of all JSONL files under a folder; a folder with both is an error."""
    kinds = {os.path.splitext(r.path)[1] for r in _files(spark, folder, "*.{txt,jsonl}").select(F.concat(F.lit("x."), F.element_at(F.split("path", r"\."), -1)).alias("path")).distinct().collect()}
    if len(kinds) > 1:
        raise ValueError(f"{folder} holds files of several kinds: {', '.join(sorted(kinds))}")
    return read_jsonl(spark, folder, TEXT) if kinds == {".jsonl"} else read_text(spark, folder, linebreaks)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text without a header; columns by place."""
    return spark.read.option("sep", "\t").option("header", False).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def read_named(spark: SparkSession, name: str, split: str | None = None) -> DataFrame:
    """A table of the catalog, or of its rows those of a split."""
    df = spark.table(name)
    return df.where(F.col("split") == split) if split else df


def read_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """``value``: stripped lines; without ``blank`` only those with something in them."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("value"))
    return rows if blank else rows.where("value <> ''")


def read_raw_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines as they are, also those that are no JSON."""
    return spark.read.text(path)


def read_seed_roles(spark: SparkSession, path: str) -> DataFrame:
    """``system_prompt`` of every record that can be read and has one."""
    return spark.read.schema("system_prompt string").option("mode", "DROPMALFORMED").json(path).where("system_prompt is not null")


def markup_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, line_no, text``: the nonblank lines of a page's text, without scripts, styles and tags, entities resolved."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/title)\b[^>]*>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(ch))
    lines = F.filter(F.transform(F.split(bare, r"\R"), strip), lambda x: x != "")
    return df.select(key, F.posexplode(lines).alias("line_no", "text"))


def markdown_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, text``: the nonblank lines of Markdown without its marks."""
    t = F.regexp_replace(F.col(text), r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+|```.*$|[-*_]{3,}\s*$)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*|__|`", "")
    return markup_text(df.select(key, t.alias(text)), key, text)


def read_documents(spark: SparkSession, folder: str, skip: bool = False) -> DataFrame:
    """``path, line_no, text`` of all documents under a folder by their extension.  PDF and DOCX files need a library for
    them on the executors: without it reading them is an error, or, with ``skip``, gives one null line for each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    plain = files.withColumn("text", F.decode("content", "UTF-8")).withColumn("kind", kind)
    md = markdown_text(plain.where("kind = 'md'"), "path", "text")
    html = markup_text(plain.where("kind in ('html', 'htm')"), "path", "text")
    lines = F.filter(F.transform(F.split("text", r"\R"), strip), lambda x: x != "")
    txt = plain.where("kind not in ('md', 'html', 'htm', 'pdf', 'docx')").select("path", F.posexplode(lines).alias("line_no", "text"))
    packed = files.where(kind.isin("pdf", "docx")).mapInPandas(partial(_packed_lines, skip=skip), "path string, line_no int, text string")
    return md.unionByName(html).unionByName(txt).unionByName(packed)


def _packed_lines(batches, skip: bool = False):
    import importlib
    import io

    import pandas as pd

    def lines(path: str, content: bytes) -> list[str] | None:
        try:
            if path.lower().endswith(".docx"):
                return [p.text for p in importlib.import_module("docx").Document(io.BytesIO(content)).paragraphs]
            pages = importlib.import_module("pypdf").PdfReader(io.BytesIO(content)).pages
            return [x for p in pages for x in p.extract_text().splitlines()]
        except ImportError:
            if not skip:
                raise
            return None

    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            found = lines(path, content)
            rows += [(path, None, None)] if found is None else [(path, k, t.strip()) for k, t in enumerate(found) if t.strip()]
        yield pd.DataFrame(rows, columns=["path", "line_no", "text"]).astype({"line_no": "Int32"})
