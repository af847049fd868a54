"""Command line: ``python -m kasumi.cli mask|audit|candidates|ner|debug FILE...``.

``ner`` and ``debug`` need a recogniser, a loader as in ``operators.recognise``, named ``module:function``; the others
take one too. Results go to standard output, or to a folder as Parquet, or as text: a file of lines for each result, and
for texts and pages of HTML a folder for each document.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasumi.operators import entities
from kasumi.operators.dictionary import Dictionary, leaks, tokens
from kasumi.operators.recognise import Load, analysed, entities_of, labelled_tokens
from kasumi.operators.spans import highlighted
from kasumi.plans import reports
from kasumi.plans.masking import Masking, settled
from kasumi.sources.lists import load_allowlist, load_dictionary
from kasumi.sources.loaders import load_chunks

SAMPLE = "Write to info@example.com or sales@example.org.\n\n| name | mail |\n|---|---|\n| Smith | smith@example.com |"


def documents(spark: SparkSession, files: list[str], text: str | None) -> DataFrame:
    """(doc_id, chunks) of files, of a text, or of a sample."""
    if files:
        return load_chunks(spark, files).withColumnRenamed("path", "doc_id")
    return spark.createDataFrame([("text", [SAMPLE if text is None else text])], "doc_id string, chunks array<string>")


COMMANDS = {
    "mask": "write masked texts and their mapping",
    "audit": "show how channels voted, and terms inside other words",
    "candidates": "show what was found",
    "ner": "show what a recogniser finds, and pages with it marked",
    "debug": "show tokens with tags and labels, and their summary",
}
#: Columns that hold a whole document, and what its file is called.
BODIES = {"masked_text": "txt", "html": "html"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kasumi", description="Finds and masks sensitive text.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in COMMANDS.items():
        own = commands.add_parser(name, help=what)
        own.add_argument("files", nargs="*", help="files or folders; a sample without any")
        own.add_argument("--text", help="a text instead of files")
        own.add_argument("--recogniser", required=name in ("ner", "debug"), help="a model's loader, as module:function")
        own.add_argument("--out", help="folder instead of standard output")
        own.add_argument("--format", choices=("parquet", "text"), default="parquet", help="of files in that folder")
        if name in ("ner", "debug"):
            own.add_argument("--flatten", action="store_true", help="make sentences of Markdown tables first")
        if name == "ner":
            own.add_argument("--labels", action="append", metavar="LABEL", help="these labels only; may be repeated")
        if name == "debug":
            own.add_argument("--all-tokens", action="store_true", help="also tokens that are neither names nor labelled nor unknown")
        if name in ("mask", "audit", "candidates"):
            own.add_argument("--dict", dest="dictionary", help="YAML file of terms")
            own.add_argument("--allow", help="YAML file of harmless surfaces")
            own.add_argument("--no-flatten", action="store_true", help="leave Markdown tables as they are")
            own.add_argument("--surfaces", action="store_true", help="show surfaces in audits")
    return top


def named(loader: str | None) -> Load | None:
    if loader is None:
        return None
    module, _, function = loader.partition(":")
    return getattr(importlib.import_module(module), function)


def recognised(spark: SparkSession, options: argparse.Namespace) -> dict[str, DataFrame]:
    """What ``ner`` and ``debug`` show."""
    bodies = settled(Masking(flatten=options.flatten).bodies(documents(spark, options.files, options.text)))
    found = settled(analysed(bodies, named(options.recogniser)))
    if options.command == "debug":
        tokens_ = labelled_tokens(found)
        return {"tokens": reports.token_report(tokens_, all_tokens=options.all_tokens).orderBy("doc_id", "i"), "summary": reports.token_summary(tokens_)}
    spans = entities_of(found)
    spans = reports.labelled(spans, options.labels) if options.labels else spans
    return {"entities": spans.select("surface", "label", "start", "end", "doc_id").orderBy("doc_id", "start", "end"), "pages": highlighted(bodies, spans)}


def results(spark: SparkSession, options: argparse.Namespace) -> dict[str, DataFrame]:
    """What a command shows, by name."""
    if options.command in ("ner", "debug"):
        return recognised(spark, options)
    load = named(options.recogniser)
    detectors = {"model": lambda texts: entities_of(analysed(texts, load))} if load else {}
    masking = Masking(load_dictionary(options.dictionary) if options.dictionary else Dictionary(), detectors, allowlist=load_allowlist(options.allow) if options.allow else None, flatten=not options.no_flatten, tagger=load)
    analysis = masking.analyze(documents(spark, options.files, options.text))
    if options.command == "candidates":
        return {"candidates": reports.review(analysis.candidates).drop("votes")}
    if options.command == "audit":
        audit = reports.audit(analysis.candidates)
        found = audit if options.surfaces else audit.groupBy("category", "confidence", "split").agg(F.count("*").alias("candidates"))
        if not masking.dictionary:
            return {"votes": found}
        return {"votes": found, "leaks": reports.leak_report(leaks(tokens(analysis.tokenized), masking.dictionary), redacted=not options.surfaces)}
    chosen = entities.chosen_by_entity(analysis.candidates, masking.dictionary)
    masked = masking.apply(analysis, chosen)
    return {"texts": masked.texts, "mapping": masked.mapping}


def written(rows: DataFrame, folder: str, kind: str) -> None:
    if kind == "parquet":
        rows.write.mode("overwrite").parquet(folder)
        return
    body = next((c for c in rows.columns if c in BODIES), None)
    if body:  # a folder for each document
        rows.select("doc_id", F.col(body).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(folder)
        return
    cells = [F.coalesce(F.col(c).cast("string") if t in ("string", "int", "bigint", "boolean", "double") else F.to_json(c), F.lit("")) for c, t in rows.dtypes]
    rows.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(folder)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("kasumi").getOrCreate()
    for name, rows in results(spark, options).items():
        if options.out:
            written(rows, f"{options.out}/{name}", options.format)
        else:
            print(f"# {name}")
            for row in rows.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
