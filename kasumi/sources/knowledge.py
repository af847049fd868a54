"""A knowledge base over a client, as a Spark data source: one task per document.

A client is an object with ``list_documents()`` and ``get_document(id)``, made on
the executors by a function that the reader is given. Answers may be lists or maps
with the documents under one of several names; chunks have their text under one of
two.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed: where answers hold their documents, and chunks their text.
LIST_KEYS, TEXT_KEYS = ("documents", "items", "data"), ("text", "page_content")


def listed(answer: Any) -> list[dict]:
    """The documents of an answer."""
    if isinstance(answer, str):
        answer = json.loads(answer)
    if isinstance(answer, dict):
        answer = next((answer[k] for k in LIST_KEYS if isinstance(answer.get(k), list)), [])
    return [x if isinstance(x, dict) else {"id": str(x)} for x in answer]


def chunk_texts(document: Any) -> list[str]:
    """The texts of a document's chunks without blank ones; its content if it has no chunks."""
    if isinstance(document, str):
        document = json.loads(document)
    texts = []
    for chunk in document.get("chunks") or []:
        text = chunk if isinstance(chunk, str) else next((chunk[k] for k in TEXT_KEYS if chunk.get(k)), "")
        if text.strip():
            texts.append(text)
    content = document.get("content") or ""
    return texts or ([content] if content.strip() else [])


def root_cause(error: BaseException) -> BaseException:
    """The first error inside groups and chains."""
    while True:
        inner = error.exceptions[0] if isinstance(error, BaseExceptionGroup) else error.__cause__
        if inner is None:
            return error
        error = inner


def read(spark: SparkSession, client: Callable[[], Any], *, tasks: int = 8) -> DataFrame:
    """(id, title, chunks) of all documents; ids are listed once, documents are fetched by the tasks."""
    found = listed(client().list_documents())
    rows = [(str(d.get("id") or d.get("document_id") or d.get("name") or ""), str(d.get("title") or d.get("name") or "")) for d in found]
    ids = spark.createDataFrame(rows, "id string, title string").repartition(max(1, min(tasks, len(rows))))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        for batch in batches:
            chunks = []
            for i in batch.column(0).to_pylist():
                try:
                    chunks.append(chunk_texts(own.get_document(i)))
                except Exception as error:
                    raise RuntimeError(f"{i}: {root_cause(error)}") from error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.list_(pa.string()))], names=["id", "title", "chunks"])

    return ids.mapInArrow(fetched, "id string, title string, chunks array<string>")
