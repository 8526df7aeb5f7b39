"""Reading and writing the tables of the engine: CSV, JSON lines, YAML, DOCX, XLSX, runs, logs, caches, manifests, reports."""

from __future__ import annotations

import hashlib
import importlib
import io as bytes_io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from citewright.functions.text import clean_cell


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, quoted line breaks kept, a byte-order mark on the first name dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = reader.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a known schema; blank lines give no rows."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_run(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score), to the depth given."""
    df = read_csv(spark, path)
    key = "question_id" if "question_id" in df.columns else "query_id"
    doc = "chunk_id" if "chunk_id" in df.columns else "doc_id"
    run = df.select(F.col(key).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col(doc).alias("doc_id"), F.col("score").cast("double").alias("score"))
    return run if depth is None else run.filter(F.col("rank") <= depth)


def read_amendments(spark: SparkSession, path: str) -> list[dict]:
    """Operations of a YAML list by effective date, then place in the file. The log is read whole: it is written by hand."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    ops = yaml.safe_load(text) or []
    return [op for _, op in sorted(enumerate(ops), key=lambda x: (str(x[1].get("effective_date", "")), x[0]))]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> Iterator[str]:
    """Lines of the body paragraphs; text in tables is left out, soft breaks end a line."""
    with zipfile.ZipFile(bytes_io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for paragraph in body.findall(f"{_W}p") if body is not None else ():
        parts = ["\n" if e.tag in (f"{_W}br", f"{_W}cr") else "\t" if e.tag == f"{_W}tab" else e.text or "" for e in paragraph.iter() if e.tag in (f"{_W}t", f"{_W}br", f"{_W}cr", f"{_W}tab")]
        yield from "".join(parts).split("\n")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of every file under the path; the id is the file's name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)

    @F.pandas_udf(ArrayType(StringType()))
    def lines(content: pd.Series) -> pd.Series:
        return content.map(lambda c: list(docx_lines(c)))

    name = F.regexp_extract("path", r"([^/]+)\.docx$", 1)
    return files.select(name.alias("doc_id"), F.posexplode(lines("content")).alias("line_no", "line"))


def xlsx_rows(content: bytes, sheet: str) -> list[list[str]]:
    """Cells of a sheet as text, by rows; missing cells are empty."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(bytes_io.BytesIO(content)) as z:
        names = z.namelist()
        strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        data = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheets.index(sheet) + 1}.xml"))
    rows = []
    for row in data.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", ns):
            letters = "".join(x for x in c.get("r", "A") if x.isalpha())
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            value = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else (v.text or "") if v is not None else ""
            cells[at - 1] = strings[int(value)] if c.get("t") == "s" and value else value
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str, sheet: str, required: list[str]) -> DataFrame:
    """A label sheet as text, cells cleaned; a missing required column is an error."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    header, *rows = xlsx_rows(content, sheet)
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    schema = StructType([StructField(c, StringType()) for c in header])
    df = spark.createDataFrame([[*r, *[""] * (len(header) - len(r))] for r in rows if any(r)], schema)
    return df.select([clean_cell(F.col(f"`{c}`")).alias(c) for c in header])


def write_json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    (df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)).write.json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.option("header", True).option("escape", '"').csv(path)


def save_run(run: DataFrame, path: str, digits: int = 4) -> None:
    write_csv(run.select("query_id", "rank", "doc_id", F.round("score", digits).alias("score")), path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most ``most`` rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    rows = df.limit(most).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) over equal widths between the least and the greatest value."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    width = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(1.0)
    rows = df.crossJoin(F.broadcast(ends.withColumn("w", width)))  # a row
    k = F.least(F.floor((F.col(column) - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(column).isNotNull()).groupBy(k.alias("bin"), "a", "w").agg(F.count("*").alias("count")).select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), "count")


def manifest(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(manifest): a JSON object of each table's rows and a hash that does not depend on their order."""
    parts = None
    for name, df in tables.items():
        rows = df.select(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256).alias("h"))
        one = rows.agg(F.count("*").alias("rows"), F.md5(F.concat_ws(",", F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"))).alias("hash")).select(F.lit(name).alias("name"), F.struct("rows", "hash").alias("v"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v"))))).alias("manifest"))


class LogStore:
    """Queries and feedback as append-only Parquet; the latest rating of a query counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, queries: DataFrame) -> None:
        """queries (time, question, refused, top_chunk_id, top_score, reason, n_parts, pipeline); ids follow time and text."""
        key = F.xxhash64("time", "question")
        queries.withColumn("id", F.coalesce(F.col("id"), key) if "id" in queries.columns else key).write.mode("append").parquet(f"{self.path}/queries")

    def rate(self, feedback: DataFrame) -> None:
        """feedback (query_id, rating, comment, time); ratings other than -1 and 1 are an error."""
        checked = feedback.withColumn("rating", F.when(F.col("rating").isin(-1, 1), F.col("rating")).otherwise(F.raise_error(F.lit("rating must be -1 or 1"))))
        checked.withColumn("seq", F.monotonically_increasing_id()).write.mode("append").parquet(f"{self.path}/feedback")

    def queries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/queries")

    def feedback(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/feedback")


def cached_vectors(texts: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, model: str, max_length: int) -> DataFrame:
    """encode(texts), kept as Parquet under a key of the model, its length limit and the texts."""
    spark = texts.sparkSession
    total = texts.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()
    name = hashlib.sha256(json.dumps([model, max_length, *map(str, total)]).encode()).hexdigest()[:12]
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        encode(texts).write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def load_retriever(name: str | None, fallback: Callable) -> Callable:
    """The callable that ``module:function`` names, or the fallback if there is no name or it cannot be loaded."""
    if not name:
        return fallback
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError):
        return fallback


def pair_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A scorer of (question, text) pairs for reranking, batch by batch over Arrow."""

    @F.pandas_udf(DoubleType())
    def udf(question: pd.Series, text: pd.Series) -> pd.Series:
        return score(question, text)

    return udf


def newest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row for each key, the newest."""
    order = Window.partitionBy(key).orderBy(F.desc(time))
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def to_table(df: DataFrame) -> pa.Table:
    return df.toArrow()
