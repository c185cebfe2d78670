"""JSON exports with a metadata block, written by a data source whose commit makes them readable.

An export is a folder ``<institution>_<data_type>_<kind>_<stamp>`` of JSON lines and one ``metadata.json``.  Tasks write files with
names of their own; the commit lists the files of the tasks that count, with their rows, in ``metadata.json``; readers take
the listed files only.  An export whose job failed has no such file, and its abort removes the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

KINDS = ("raw", "processed")
LISTED = "metadata.json"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class JsonExportWriter(DataSourceWriter):
    def __init__(self, path: str, block: dict):
        self.path, self.block = path.rstrip("/"), block

    def write(self, iterator: Iterator[Row]) -> Written:
        """One file of the task's records, which come as JSON texts."""
        files, path = _filesystem(self.path)
        name, n = f"part-{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(f"{path}/{name}") as out:
            for row in iterator:
                out.write(row[0].encode("utf-8") + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        parts = [{"file": m.file, "rows": m.rows} for m in messages if m is not None]
        files, path = _filesystem(self.path)
        files.create_dir(path)
        with files.open_output_stream(f"{path}/{LISTED}") as out:
            out.write(json.dumps(self.block | {"rows": sum(p["rows"] for p in parts), "parts": parts}, ensure_ascii=False).encode("utf-8"))

    def abort(self, messages: list[Written | None]) -> None:
        files, path = _filesystem(self.path)
        from pyarrow import fs

        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)


class JsonExport(DataSource):
    """Options: ``path``, and ``block``, the metadata as JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_export"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema: T.StructType, overwrite: bool) -> JsonExportWriter:
        """The folder is made here and not by tasks, so that one that still runs after an abort cannot make it again."""
        files, path = _filesystem(self.options["path"].rstrip("/"))
        files.create_dir(path)
        return JsonExportWriter(self.options["path"], json.loads(self.options["block"]))


def export_json(df: DataFrame, folder: str, institution: str, data_type: str, metadata: dict, kind: str = "processed", stamp: str | None = None) -> str:
    """Write the records, nulls included, and their metadata; returns the export's path.  An empty table gives an export without records."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    stamp = stamp or datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{institution}_{data_type}_{kind}_{stamp}"
    block = {"metadata": metadata, "institution": institution, "data_type": data_type, "kind": kind, "stamp": stamp, "columns": df.schema.simpleString()}
    df.sparkSession.dataSource.register(JsonExport)
    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    records.write.format("json_export").mode("append").option("path", path).option("block", json.dumps(block)).save()
    return path


def export_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata block of a complete export, with ``rows`` and ``parts``; an error for one that was not committed."""
    return json.loads(spark.read.text(f"{path}/{LISTED}", wholetext=True).first()[0])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The records of a complete export, in the columns they were written with."""
    block = export_metadata(spark, path)
    schema = T.StructType.fromDDL(block["columns"][len("struct<") : -1])
    files = [f"{path}/{p['file']}" for p in block["parts"] if p["rows"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
