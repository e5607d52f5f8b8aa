"""Folders of files as documents, and files as sinks.

Office files are small zip archives of XML; each is parsed by a small helper
inside mapInArrow. Spark lists, reads and spreads the files.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import html_to_text

ENDINGS = ("txt", "md", "csv", "html", "htm", "docx", "pptx", "xlsx", "eml", "pdf")
ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")
ROWS_PER_SHEET = None  # all rows


def plain_text(raw: bytes) -> str:
    """The text in the first encoding that fits."""
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return ""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _numbered(names: list[str], pattern: str) -> list[str]:
    """Archive members that match, in the order of their numbers."""
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n).group(1)))


def docx_text(raw: bytes) -> str:
    """Paragraphs, headings as Markdown, tables as rows with bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(iter(ElementTree.fromstring(z.read("word/document.xml"))), None)
    out = []

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")

    for node in body if body is not None else ():
        if _local(node.tag) == "tbl":
            rows = [r for r in node if _local(r.tag) == "tr"]
            out.append("\n".join("| " + " | ".join(words(c).strip() for c in r if _local(c.tag) == "tc") + " |" for r in rows))
        elif _local(node.tag) == "p":
            style = next((v for s in node.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
            if text := words(node).strip():
                out.append("#" * int(level.group(1)) + " " + text if level else text)
    return "\n\n".join(out)


def pptx_text(raw: bytes) -> str:
    """Slides in order, each behind its marker."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = [z.read(n) for n in _numbered(z.namelist(), r"ppt/slides/slide\d+\.xml")]
    parts = []
    for n, xml in enumerate(slides, 1):
        lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ElementTree.fromstring(xml).iter() if _local(p.tag) == "p"]
        parts.append(f"[Slide {n}]\n" + "\n".join(x for x in lines if x.strip()))
    return "\n\n".join(parts)


def xlsx_text(raw: bytes) -> str:
    """Sheets in order, rows with bars, empty cells left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = [ElementTree.fromstring(z.read(n)) for n in _numbered(names, r"xl/worksheets/sheet\d+\.xml")]
    parts = []
    for n, sheet in enumerate(sheets, 1):
        rows = []
        for row in (r for r in sheet.iter() if _local(r.tag) == "row"):
            cells = []
            for c in row:
                value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                rows.append(" | ".join(x for x in cells if x))
        parts.append(f"[Sheet {n}]\n" + "\n".join(rows))
    return "\n\n".join(parts)


def mail_text(raw: bytes) -> str:
    """Subject and body of a mail, plain text before HTML."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    part = message.get_body(("plain", "html"))
    body = part.get_content() if part else ""
    return f"Subject: {message['subject'] or ''}\n\n{body}"


def pdf_text(raw: bytes) -> str:
    """Strings of uncompressed text operators; a fallback where no PDF library is at hand."""
    found = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*Tj", raw)
    return "\n".join(re.sub(rb"\\([()\\])", rb"\1", x).decode("latin-1") for x in found)


PARSERS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "eml": mail_text, "pdf": pdf_text}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, source_type, n_bytes, digest, content of all files with a known ending, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("source_type", kind).where(kind.isin(*ENDINGS)).select("path", "source_type", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("digest"), "content")


def parse(files: DataFrame) -> DataFrame:
    """doc_key, path, source_type, digest, text, error of scan()'s files; a file that cannot be read has a null text and its error."""

    def work(batches):
        names = ["path", "source_type", "digest", "text", "error"]
        for batch in batches:
            texts, errors = [], []
            for kind, raw in zip(batch.column("source_type").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    texts.append(PARSERS.get(kind, plain_text)(raw))
                    errors.append(None)
                except Exception as e:  # a broken file must not end the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("source_type"), batch.column("digest"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=names)

    rows = files.select("path", "source_type", "digest", "content").mapInArrow(work, "path string, source_type string, digest string, text string, error string")
    text = F.when(F.col("source_type").isin("html", "htm"), html_to_text("text")).otherwise(F.col("text"))
    return rows.select(F.concat(F.col("source_type"), F.lit("_"), F.substring("digest", 1, 16)).alias("doc_key"), "path", "source_type", "digest", text.alias("text"), "error")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path and digest the index does not hold yet."""
    return files.join(known.select("path", "digest"), ["path", "digest"], "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row, behind what is there."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
