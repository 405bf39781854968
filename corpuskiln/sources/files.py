"""Sources: word files, JSON lines, labelled JSON arrays, page chunks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import legal as G

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs first, then table rows as cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    say = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    paragraphs = [say(p) for p in body.findall(f"{_W}p")]
    rows = [" | ".join(x for x in (say(c) for c in r.findall(f"{_W}tc")) if x) for t in body.iter(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n".join(x for x in paragraphs + rows if x)


def files(spark: SparkSession, path: str, pattern: str = "*.{docx,doc,txt}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def texts(raw: DataFrame) -> DataFrame:
    """(path, text, error) of binary files; a file that can't be read is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if path.endswith(".docx"):
                        rows.append((path, docx_text(bytes(content)), None))
                    elif path.endswith(".doc"):
                        rows.append((path, None, "legacy .doc files need Word"))
                    else:
                        rows.append((path, bytes(content).decode("utf-8"), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError, AttributeError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return raw.select("path", "content").mapInPandas(run, "path string, text string, error string")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank and malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str, required: list[str], limit: int | None = None) -> DataFrame:
    """Elements of a JSON array whose required fields are there and, where they are texts, not blank. ``limit`` takes
    the first ones of the file, which is one task's as a JSON array can't be split."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    kinds = dict(rows.dtypes)
    for name in required:
        filled = F.col(name).isNotNull()
        rows = rows.filter(filled & (F.trim(name) != "") if kinds.get(name) == "string" else filled)
    return rows.limit(limit) if limit else rows


def joined_pages(chunks: DataFrame, key: str) -> DataFrame:
    """Page chunks to one text by (page, chunk_id); missing numbers go last."""
    big = 10**9
    order = F.struct(F.coalesce("page", F.lit(big)).alias("p"), F.coalesce("chunk_id", F.lit(big)).alias("c"), "text")
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), "\n").alias("text"))


def number_from_name(path: Column, text: Column) -> Column:
    """A document's number from its file's name, else from its text, else the name."""
    return G.document_number(G.file_stem(path), text)
