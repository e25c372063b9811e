"""Documents from files: bytes of several encodings, word-processor files, and pages with furniture."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT, WORD = ("", "txt", "md", "markdown"), ("docx",)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> str:
    """UTF-16 by its mark or by many zero bytes, else UTF-8, else Turkish Windows, else Latin-5."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", errors="replace")
    if len(data) >= 4 and data.count(0) * 3 >= len(data):
        return data.decode("utf-16-le" if data[1::2].count(0) > data[::2].count(0) else "utf-16-be", errors="replace")
    for name in ("utf-8-sig", "cp1254"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("iso-8859-9")


def read_docx(data: bytes) -> str:
    """Paragraphs, list items as ``- ``, then the rows of tables with cells joined by a dash."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t")).strip()
    blocks: list[tuple[bool, str]] = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        style = p.find(f"{_W}pPr/{_W}pStyle")
        item = p.find(f"{_W}pPr/{_W}numPr") is not None or style is not None and "List" in (style.get(f"{_W}val") or "")
        if text := said(p):
            blocks.append((item, f"- {text}" if item else text))
    for row in body.iter(f"{_W}tr") if body is not None else ():
        if text := " – ".join(filter(None, map(said, row.findall(f"{_W}tc")))):
            blocks.append((False, text))
    out = ""
    for k, (item, text) in enumerate(blocks):
        out += ("" if not k else "\n" if item and blocks[k - 1][0] else "\n\n") + text
    return out


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, errors = [], []
        for path, data in zip(frame["path"], frame["content"], strict=True):
            name = path.rsplit("/", 1)[-1]
            kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
            try:
                texts.append(decode(bytes(data)) if kind in TEXT else read_docx(bytes(data)) if kind in WORD else None)
                errors.append(None if texts[-1] is not None else f"unsupported format: {kind}")
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                texts.append(None)
                errors.append(f"damaged file: {error}")
        yield pd.DataFrame({"path": frame["path"], "text": texts, "error": errors})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text and error of every file; a file that can't be read has an error instead of a text."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(_read, "path string, text string, error string")


def furniture_key(line: Column) -> Column:
    """A header or footer line without its page number."""
    return F.trim(F.regexp_replace(F.lower(line), "[0-9]+", "#"))


def recurring_lines(pages: DataFrame, edge: int = 4, share: float = 0.6, least: int = 3) -> DataFrame:
    """doc_id and key of lines among the first or last ``edge`` filled lines of many pages (doc_id, page, line_no, line).

    Many is ``share`` of a document's pages, and ``least`` at least.
    """
    filled = pages.where(F.rlike("line", F.lit("\\S")))
    page = Window.partitionBy("doc_id", "page")
    rank = filled.withColumn("up", F.row_number().over(page.orderBy("line_no"))).withColumn("down", F.row_number().over(page.orderBy(F.desc("line_no"))))
    near = rank.where((F.col("up") <= edge) | (F.col("down") <= edge)).withColumn("key", furniture_key(F.col("line")))
    total = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    by = near.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n")).join(total, "doc_id")
    return by.where((F.col("pages") >= least) & (F.col("n") >= F.greatest(F.lit(least), F.ceil(share * F.col("pages"))))).select("doc_id", "key", "n")


def without_furniture(pages: DataFrame) -> DataFrame:
    """The pages' lines without the recurring ones."""
    return pages.withColumn("key", furniture_key(F.col("line"))).join(recurring_lines(pages).select("doc_id", "key"), ["doc_id", "key"], "left_anti").drop("key")


#: Signs at which a line ends a thought, and signs before which no space stands.
LINE_ENDS, CLOSE_SIGNS = ".!?:;,…-–—", ".,;:!?"


def joined_letters(line: Column) -> Column:
    """A line whose words are spread out (``G E Ç E N  Y I L``) with its words whole; other lines as they are.

    A line is spread out where three letters or more stand alone in a row; then two are joined as well.
    """
    whole = F.regexp_replace(line, "(?<=(?:^|\\s)\\p{L}-?) (?=\\p{L}-?(?:\\s|$))", "")
    spread = F.rlike(line, F.lit("(?:^|\\s)\\p{L}-?(?: \\p{L}-?){2,}(?:\\s|$)"))
    return F.when(spread, F.regexp_replace(whole, "(?<=\\S) {2,}(?=\\S)", " ")).otherwise(line)


def tidy_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages (doc_id, page, line_no, line) with whole words, no space before a sign, and ``breaks``.

    A line ends its paragraph where it has no end sign and less than 0.6 of its page's widest line, and the
    next begins with a capital. Null lines count as empty.
    """
    page = Window.partitionBy("doc_id", "page")
    rows = pages.withColumn("line", F.rtrim(joined_letters(F.coalesce("line", F.lit("")))))
    rows = rows.withColumn("bare", F.trim("line"))
    rows = rows.withColumns({"widest": F.max(F.length("bare")).over(page), "next": F.lead("bare").over(page.orderBy("line_no"))})
    ended = F.right("bare", F.lit(1)).isin(*LINE_ENDS)
    breaks = (F.length("bare") > 0) & ~ended & F.rlike("next", F.lit("^\\p{Lu}")) & (F.length("bare") < 0.6 * F.col("widest"))
    return rows.select("doc_id", "page", "line_no", F.regexp_replace("line", f"(?<=[\\p{{L}}\\p{{Nd}}_]) +([{CLOSE_SIGNS}])(?=\\s|$)", "$1").alias("line"), F.coalesce(breaks, F.lit(False)).alias("breaks"))


def tidy_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, n_breaks and text of every page, with an empty line after each line that ends a paragraph."""
    lines = tidy_lines(pages).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "breaks"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.when(x["breaks"], "\n").otherwise(""))), "\n")
    return lines.select("doc_id", "page", F.size(F.filter("lines", lambda x: x["breaks"])).alias("n_breaks"), F.trim(text, F.lit(" \n")).alias("text"))
