"""Commands: preprocess, inspect, convert, clean, schema, ask."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("preprocess", help="markdown tree to pages, chunks and a report")
    p.add_argument("--content-root", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--max-tokens", type=int, default=1000)
    p = sub.add_parser("inspect", help="counts and loose classes of Turtle files")
    p.add_argument("path")
    p = sub.add_parser("convert", help="ontology JSON to validated and inferred Turtle")
    p.add_argument("--ontology", required=True)
    p.add_argument("--output", required=True)
    p = sub.add_parser("clean", help="five-phase instance clean-up of an ontology")
    p.add_argument("--ontology", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--decisions", help="recorded model outputs (operator, key, output) as JSON lines")
    p.add_argument("--phases", help="folder of the phases' tables")
    p.add_argument("--resume-from", type=int)
    p = sub.add_parser("schema", help="classes and properties of an upper ontology as JSON")
    p.add_argument("path")
    p.add_argument("--output", required=True)
    p = sub.add_parser("ask", help="answer questions, one per line")
    p.add_argument("--kb", required=True, help="folder of Turtle files")
    p.add_argument("--questions", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--decisions")
    a = top.parse_args(argv)

    from .model import Recorded, Rules
    from .operators import triples as tr
    from .sources import files
    from .sources.turtle import read_turtle, write_turtle

    spark = SparkSession.builder.appName(f"graphloom-{a.command}").getOrCreate()
    decided = getattr(a, "decisions", None)
    provider = Recorded(spark.read.schema("operator string, key string, output string").json(decided)) if decided else Rules()

    def assertions(doc):
        rows = files.read_ontology(spark, doc)
        return rows | {"abox": rows["abox"].withColumn("assertion_id", F.monotonically_increasing_id()), "classes": rows["classes"].withColumnRenamed("id", "class")}

    match a.command:
        case "preprocess":
            from .plans.preprocess import preprocess

            preprocess(spark, a.content_root, a.output_dir, a.max_tokens).show(truncate=False, vertical=True)
        case "inspect":
            t = read_turtle(spark, a.path).cache()
            tr.stats(t).show()
            tr.loose_classes(t).show(1000, False)
        case "convert":
            from .plans.build import kb_triples

            write_turtle(kb_triples(assertions(a.ontology)), a.output)
        case "clean":
            from .common import cut
            from .plans.build import resolve_instances

            kb = assertions(a.ontology)
            kb["abox"] = cut(kb["abox"], "abox")
            files.write_ontology(resolve_instances(kb, provider, a.phases, a.resume_from), a.output)
        case "schema":
            t = read_turtle(spark, a.path).cache()
            tr.schema_classes(t).coalesce(1).write.mode("overwrite").json(f"{a.output}/classes")
            tr.schema_properties(t).coalesce(1).write.mode("overwrite").json(f"{a.output}/axioms")
        case "ask":
            from .common import cut
            from .plans.answer import answer

            q = spark.read.text(a.questions).where("trim(value) <> ''").select(F.xxhash64("value").cast("string").alias("key"), F.col("value").alias("question"))
            files.write_logs(answer(q, cut(read_turtle(spark, a.kb), "kb"), provider), a.output, "ask")


if __name__ == "__main__":
    main()
