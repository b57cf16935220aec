"""Readers of landed files: text, Markdown, HTML, JSON in several layouts, site maps.

Each returns a DataFrame by Spark's own readers; only bytes that Spark cannot parse (HTML, broken UTF-8) pass
through an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# fixed values: media types by extension
MEDIA = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "json": "application/json", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def media_type(path: Column) -> Column:
    """Media type by extension, in any letter case; null for an unknown one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = None
    for k, v in MEDIA.items():
        out = F.when(ext == k, v) if out is None else out.when(ext == k, v)
    return out


@pandas_udf(T.StringType())
def decode_utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, media_type, title (name without extension), text: text-like files decoded, broken bytes replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = media_type(F.col("path"))
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return raw.select("path", kind.alias("media_type"), title.alias("title"), F.when(kind.startswith("text/"), decode_utf8("content")).alias("text"), "length")


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, section_no, level, heading, text: a section a heading; what precedes the first heading is left out.
    Null and empty texts have no section."""
    head = r"#{1,6}[^\S\n]+\S"
    parts = F.filter(F.split(text_col, rf"(?md)^(?={head})"), lambda x: x.rlike(f"^{head}"))
    s = docs.select(id_col, F.size(parts).alias("n"), F.posexplode(parts).alias("pos", "part"))
    first = F.regexp_extract("part", r"^([^\n]*)", 1)
    rest = F.when(F.contains("part", F.lit("\n")), F.regexp_replace("part", r"^[^\n]*\n", "")).otherwise("")
    rest = F.when(F.col("pos") < F.col("n") - 1, F.regexp_replace(rest, r"\n\z", "")).otherwise(rest)  # the line end before the next heading
    return s.select(id_col, (F.col("pos") + 1).cast("long").alias("section_no"), F.length(F.regexp_extract(first, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(first, r"^#+\s+", "")).alias("heading"), F.trim(rest).alias("text"))


class _Sections(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.tag, self.skip = "", [], "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        self.tag = tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.parts.append([int(tag[1]), "", ""])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        self.tag = ""

    def handle_data(self, data):
        if self.skip:
            return
        if self.tag == "title":
            self.title += data
        elif self.parts and self.tag == f"h{self.parts[-1][0]}":
            self.parts[-1][1] += data
        elif self.parts and data.strip():
            self.parts[-1][2] += (" " if self.parts[-1][2] else "") + " ".join(data.split())


def html_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, section_no, level, heading, text of the headings h1 to h6; scripts and styles are left out."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b[id_col], b[text_col]):
                p = _Sections()
                p.feed(text or "")
                rows += [(key, i + 1, lv, h.strip(), t) for i, (lv, h, t) in enumerate(p.parts)]
            yield pd.DataFrame(rows, columns=[id_col, "section_no", "level", "heading", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, section_no int, level int, heading string, text string")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that is a JSON array, one object with `entries`, or one object a line."""
    start = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    head = start[0][0].lstrip() if start else ""
    if head.startswith("["):
        return spark.read.schema(schema).json(path, multiLine=True)
    if '"entries"' in head or head.rstrip() == "{":
        return spark.read.schema(f"entries array<struct<{', '.join(f'{n}:{t}' for n, t in (c.strip().split(' ', 1) for c in schema.split(',')))}>>").json(path, multiLine=True).select(F.inline("entries"))
    return spark.read.schema(schema).json(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url, year, month of the entries of a site map."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return raw.select(F.trim("loc").alias("url"), F.substring("lastmod", 1, 4).try_cast("int").alias("year"), F.substring("lastmod", 6, 2).try_cast("int").alias("month"))
