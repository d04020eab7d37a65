"""Writers: append, results, spreadsheets, snapshots, reports and sidecars (SNK-07, SNK-10, SNK-13..19, AGG-32, EXT-05).

Tables and result files are written by the executors. What is rendered in the driver (a report, a sheet) is a small aggregate
and refused beyond ``MOST_ROWS`` rows.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import delete_path

#: Most rows that a report or a sheet may have.
MOST_ROWS = 100_000


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Add rows to a Parquet table, making it if need be (SNK-07)."""
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def recreate(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table in place of any at the path (SNK-10)."""
    delete_path(spark, path)
    spark.createDataFrame([], schema).write.parquet(path)


def _flat(df: DataFrame, digits: int) -> DataFrame:
    """Lists as text joined by ``;``, fractions with a fixed number of digits."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("array"):
            out[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ";")
        elif kind in ("double", "float"):
            out[f.name] = F.when(F.col(f.name).isNotNull(), F.format_string(f"%.{digits}f", F.col(f.name)))
        elif kind.startswith(("struct", "map")):
            out[f.name] = F.to_json(f.name)
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Rows as CSV with a header (SNK-13)."""
    _flat(df, digits).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept (SNK-13)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows: write CSV or Parquet instead")
    return rows


def _cell(ref: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, int | float):
        text = escape("".join(c for c in str(value) if c >= " " or c in "\t\n\r"))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def write_xlsx(df: DataFrame, path: str) -> None:
    """A bounded number of rows as a workbook of one sheet with a header (SNK-14)."""
    rows = [df.columns, *(tuple(r) for r in _bounded(_flat(df, 6).select(*df.columns)))]
    sheet = "".join(f'<row r="{i}">' + "".join(_cell(f"{_column(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    main, head = "http://schemas.openxmlformats.org", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    book = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{book}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{book}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r1" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, head + text)


def read_xlsx(path: str) -> list[list[str | None]]:
    """The first sheet's cells as text, row by row (SRC-09)."""
    import re
    from xml.etree import ElementTree as E

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        out = []
        for row in E.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{ns}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{ns}c")):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = k
                if letters:
                    at = -1
                    for x in letters[0]:
                        at = (at + 1) * 26 + ord(x) - 65
                v = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def query_list(spark: SparkSession, rows: Iterable[list[str | None]]) -> DataFrame:
    """``(query_id, query, ...)`` from a sheet with a header: rows without a query go, missing ids are ``Q`` and the number of the
    row in the sheet (SRC-09)."""
    header, *body = [list(r) for r in rows]
    if "query" not in header:
        raise ValueError("no column named query")
    records = []
    for i, r in enumerate(body, 1):
        d = dict(zip(header, [*r, *[None] * (len(header) - len(r))]))
        if (d["query"] or "").strip():
            records.append(tuple([d.get("query_id") or f"Q{i:03d}", *(d[c] for c in header if c != "query_id")]))
    return spark.createDataFrame(records, ", ".join(f"`{c}` string" for c in ["query_id", *(c for c in header if c != "query_id")]))


def write_cleaned(cleaned: DataFrame, path: str) -> None:
    """Cleaned documents as JSON with their quality beside them (SNK-16).

    ``cleaned``: ``doc_id, source, clean`` and the columns ``quality_level, alpha_ratio, chars_before, chars_after, reduction_pct``."""
    quality = F.struct(F.col("quality_level").alias("level"), "alpha_ratio", "chars_before", "chars_after", "reduction_pct")
    write_json(cleaned.select("doc_id", "source", F.col("clean").alias("content"), quality.alias("_quality")), path)


def markdown(title: str, sections: dict[str, DataFrame], path: str) -> None:
    """A report of small aggregates as Markdown tables, each in the order it comes in (SNK-17)."""
    lines = [f"# {title}", ""]
    plain = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    for name, df in sections.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join(map(plain, r)) + " |" for r in _bounded(df)] + [""]
    Path(path).write_text("\n".join(lines), encoding="utf-8")


def backup(spark: SparkSession, path: str, target: str) -> None:
    """Copy a table's rows to a snapshot; one that is there is not overwritten (SNK-18)."""
    spark.read.parquet(path).write.mode("error").parquet(target)


def restore(spark: SparkSession, snapshot: str, path: str) -> None:
    """Put a snapshot in place of a table (SNK-18)."""
    from corpusloom.operators.store import replace_table

    replace_table(spark.read.parquet(snapshot), path)


def write_sidecar(folder: str, name: str, content: bytes, fields: dict) -> None:
    """An original file and its fields in ``<stem>_meta.json`` beside it (SNK-15)."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_bytes(content)
    (at / f"{Path(name).stem}_meta.json").write_text(json.dumps(fields, ensure_ascii=False, indent=2), encoding="utf-8")


def file_count(spark: SparkSession, folder: str) -> int:
    """Files below a folder other than JSON (AGG-32)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.filter(~F.lower("path").endswith(".json")).count()


def append_turns(history: DataFrame, turns: DataFrame) -> DataFrame:
    """``history`` (``session_id, turn, role, content``) with a question and an answer of each session after its last turn (SNK-19).

    ``turns``: ``session_id, question, answer``, one pair a session."""
    last = history.groupBy("session_id").agg(F.max("turn").alias("_last"))
    pairs = turns.join(last, "session_id", "left").withColumn("_next", F.coalesce(F.col("_last") + 1, F.lit(0)))
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    new = pairs.select("session_id", "_next", F.explode(both).alias("m")).select("session_id", (F.col("_next") + F.col("m.k")).alias("turn"), "m.role", "m.content")
    return history.select("session_id", "turn", "role", "content").unionByName(new)


def migrate(spark: SparkSession, folder: str, done: str) -> list[str]:
    """Run the SQL scripts of a folder in the order of their names, each once; ``done`` lists those that ran (EXT-05)."""
    state = Path(done)
    ran = state.read_text().split("\n") if state.exists() else []
    new = [p for p in sorted(Path(folder).glob("*.sql")) if p.name not in ran]
    for p in new:
        for statement in p.read_text(encoding="utf-8").split(";"):
            if statement.strip():
                spark.sql(statement)
        ran.append(p.name)
        state.write_text("\n".join(ran))
    return [p.name for p in new]
