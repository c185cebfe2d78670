"""Question and answer pairs from mail files."""

from __future__ import annotations

import codecs
import email
import email.policy
import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from enquira.functions.pii import redact
from enquira.operators.forms import plain_pairs

HEADERS = ["from", "to", "subject", "date"]


def read_mail_files(spark: SparkSession, root: str, glob: str = "*.eml") -> DataFrame:
    """(path, source_file, content) of all mail files below a folder; source_file is the file's name
    with personal data redacted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", redact(F.element_at(F.split("path", "/"), -1)).alias("source_file"), "content")


#: Mails that a task writes.
FILES = 500


def write_mail_files(mails: DataFrame, key: str, path: str) -> None:
    """A file per row of (key, value) in a folder.

    A small table holds many mails: they are dealt out by key before they are written, and each task puts its own files in place,
    so neither one task nor the driver handles all of them; no mail has a folder of its own."""
    parts = max(1, -(-mails.count() // FILES))
    mails.repartition(parts, key).select("value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1).text(path)


#: The form's table, up to its end or that of the body; cells with their tags; a cell's id; any tag.
TABLE = r"(?is)<table\b[^>]*\bid\s*=\s*[\"']?[^\"'>]*emailFieldsTable[^>]*>.*?(?:</table|\z)"
CELL = r"(?is)<td\b[^>]*>.*?</td"
CELL_ID = r"(?is)^<td\b[^>]*?\bid\s*=\s*[\"']?([^\"'>\s]*)"
TAG = r"(?s)<[^>]*(?:>|\z)"


def field_pairs(body: Column) -> Column:
    """Questions and answers of the form's table as an array of (pos, question, answer), with entities as they stand.

    Of the cells whose ids name a question or a value, each value right after a question makes a pair."""
    cells = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(TABLE), F.lit(0)), lambda t: F.regexp_extract_all(t, F.lit(CELL), F.lit(0))))

    def read(cell: Column) -> Column:
        of = F.regexp_extract(cell, CELL_ID, 1)
        texts = F.filter(F.split(cell, TAG), lambda x: x != "")
        kind = F.when(of.contains("question"), "q").when(of.contains("value"), "v")
        return F.struct(kind.alias("kind"), F.regexp_replace(F.array_join(texts, " "), r"^\s+|\s+$", "").alias("said"))

    found = F.filter(F.transform(cells, read), lambda c: c["kind"].isNotNull())
    follows = F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(0))), lambda q, v: F.struct(q.alias("q"), v.alias("v")))
    pairs = F.filter(follows, lambda p: (p["q"]["kind"] == "q") & (p["v"]["kind"] == "v"))
    return F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["q"]["said"].alias("question"), p["v"]["said"].alias("answer")))


@F.pandas_udf(StringType())
def plain_entities(texts: pd.Series) -> pd.Series:
    """Character references as the characters they stand for."""
    return texts.map(html.unescape, na_action="ignore")


def _text(part: email.message.Message) -> str:
    try:
        codec = codecs.lookup(part.get_content_charset("utf-8")).name
    except LookupError:
        codec = "utf-8"
    return (part.get_payload(decode=True) or b"").decode(codec, "ignore")


def parsed_mails(mails: DataFrame) -> DataFrame:
    """(source_file, from, to, subject, date, html, plain, error): one row per mail of (source_file, content), with
    its HTML and its plain parts joined; a mail that cannot be read has its error and no text."""

    def opened(content: bytes) -> list:
        mail = email.message_from_bytes(bytes(content), policy=email.policy.default)
        parts = [(p.get_content_subtype(), _text(p)) for p in mail.walk() if p.get_content_maintype() == "text"]
        return [*(str(mail.get(h) or "").strip() for h in HEADERS), *("".join(t for kind, t in parts if kind == k) for k in ("html", "plain")), None]

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["source_file"], pdf["content"]):
                try:
                    rows.append([name, *opened(content)])
                except Exception as e:  # failures are counted, not fatal
                    rows.append([name, *[""] * (len(HEADERS) + 2), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=["source_file", *HEADERS, "html", "plain", "error"])

    columns = ", ".join(f"`{c}` string" for c in ("source_file", *HEADERS, "html", "plain", "error"))
    return mails.select("source_file", "content").mapInPandas(run, columns)


def mail_to_pairs(parsed: DataFrame) -> DataFrame:
    """(source_file, headers, source, pos, question, answer): the pairs of the form's table, or, for mails
    without any, those of the plain body."""
    columns = ["source_file", *HEADERS]
    rows = parsed.select(*columns, "plain", field_pairs(F.col("html")).alias("pairs"))
    form = rows.select(*columns, F.lit("html").alias("source"), F.explode("pairs").alias("p"))
    form = form.select(*columns, "source", "p.pos", plain_entities("p.question").alias("question"), plain_entities("p.answer").alias("answer"))
    bare = rows.where((F.size("pairs") == 0) & (F.col("plain") != ""))
    plain = plain_pairs(bare, "source_file", "plain").join(bare.select(*columns), "source_file")
    return form.unionByName(plain.select(*columns, F.lit("plain").alias("source"), "pos", "question", "answer"))


def mail_summary(parsed: DataFrame) -> DataFrame:
    """Mails read and failed."""
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
