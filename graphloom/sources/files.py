"""Readers and writers of the other files: markdown trees, JSON lines, ontology JSON, logs, prompts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import cut
from ..ddl import schema

CHUNK = schema(
    "chunk_id string, chunk_index int, page_id string, page_title string, source_path string, language string, page_type string, "
    "chunk_text_clean string, token_count int, section struct<section_index:int,section_title:string,section_level:int,part_index:int,"
    "part_total:int,part_label:string,prev_section_title:string,next_section_title:string,group_size:int,group_start_index:int,"
    "group_end_index:int,group_titles:array<string>>, provenance struct<title:string,date:string,externalUrl:string>, "
    "quality_flags struct<has_html_residue:boolean,has_shortcode_residue:boolean>")
CLASS = schema("id string, description string, chunk_ids array<int>")
AXIOM = schema(
    "type string, subclass string, superclass string, domain string, property string, range string, datatype string, description string, "
    "domains array<string>, ranges array<string>, chunk_id int")
ASSERTION = schema(
    "type string, id string, individual string, class string, subject string, property string, object string, value string, datatype string, "
    "individuals array<string>, chunk_id int")
ONTOLOGY = T.StructType([
    T.StructField("ontology_tbox", T.StructType([T.StructField("classes", T.ArrayType(CLASS)), T.StructField("axioms", T.ArrayType(AXIOM))])),
    T.StructField("ontology_abox", T.ArrayType(ASSERTION)), T.StructField("pruned", T.MapType(T.StringType(), T.ArrayType(ASSERTION))),
])
BASE_CLASS = schema("class string, parents array<string>, description string")


def read_markdown(spark: SparkSession, root: str, glob: str = "*.en.md") -> DataFrame:
    """``(source_path, raw)`` of all matching files below ``root``; paths are relative to it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    base = root.rstrip("/").split("://")[-1]
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_replace(path, f"^.*?{_quoted(base)}/", "").alias("source_path"), F.col("value").alias("raw"))


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?()[]{}|\\" else c for c in s)


def read_chunks(spark: SparkSession, path: str, skip: DataFrame | None = None) -> DataFrame:
    """Chunk records from JSON lines, without those whose chunk_id stands in ``skip``."""
    rows = spark.read.schema(CHUNK).json(path)
    return rows.join(skip.select("chunk_id").distinct(), "chunk_id", "left_anti") if skip is not None else rows


def read_texts(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """Texts of JSON lines, trimmed; empty texts and blank lines are skipped."""
    rows = spark.read.schema(T.StructType([T.StructField(field, T.StringType())])).json(path)
    return rows.select(F.trim(field).alias(field)).where(F.col(field) != "")


def read_results(spark: SparkSession, path: str, columns: str | T.StructType) -> DataFrame:
    """Evaluation records, JSON lines or one array."""
    return spark.read.schema(columns).option("multiLine", "true").json(path)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work that is not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def read_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An ontology document as tables: classes, axioms, abox, pruned (with its phase)."""
    doc = spark.read.schema(ONTOLOGY).option("multiLine", "true").json(path)
    flat = lambda c: doc.select(F.inline(c))
    pruned = doc.select(F.explode("pruned").alias("phase", "rows")).select("phase", F.inline("rows"))
    return {"classes": flat("ontology_tbox.classes"), "axioms": flat("ontology_tbox.axioms"), "abox": flat("ontology_abox"), "pruned": pruned}


def _upper(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(layout).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], layout)


def read_base_classes(spark: SparkSession, path: str) -> DataFrame:
    """Upper classes from a JSON array; a missing file gives none, a malformed record an error, never fewer rows."""
    return _upper(spark, path, BASE_CLASS)


def read_base_axioms(spark: SparkSession, path: str) -> DataFrame:
    """Upper axioms from a JSON array, as ``read_base_classes``."""
    return _upper(spark, path, AXIOM)


def append_records(rows: DataFrame, path: str) -> None:
    """Append records, such as manual annotations, as JSON lines; earlier ones stay."""
    rows.write.mode("append").json(path)


def write_ontology(tables: dict[str, DataFrame], path: str, info: dict[str, str] | None = None) -> None:
    """One Parquet table each, and a row of metadata with the counts."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = spark.range(1).select(F.current_timestamp().alias("written_at"), F.to_json(F.create_map(*[F.lit(x) for kv in (info or {"-": "-"}).items() for x in kv])).alias("info"))
    for name in tables:
        n = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias(f"num_{name}"))
        meta = meta.crossJoin(n)  # one row each
    meta.write.mode("overwrite").json(f"{path}/metadata")


def write_logs(logs: DataFrame, path: str, run_id: str) -> None:
    """Append inference logs, one JSON line each, in the folder of their run."""
    logs.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def phase(make: Callable[[], DataFrame], folder: str | None, name: str, resume: bool = False) -> DataFrame:
    """A phase's table under ``folder``: read if ``resume`` and complete, and then ``make`` is not called; else made,
    written and read back. Without a folder it goes to the scratch folder."""
    if folder is None:
        return cut(make(), name)
    spark, path = SparkSession.getActiveSession(), f"{folder}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not (resume and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_prompt(path: str) -> str:
    """A prompt's text; FileNotFoundError names the path."""
    f = Path(path)
    if not f.is_file():
        raise FileNotFoundError(f"no prompt at {path}")
    return f.read_text(encoding="utf-8")
