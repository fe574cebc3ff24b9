"""Files made from rows, for tests, benchmarks and the round-trip queries. The same rows give the same bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.sources.shipping import ship


def made(rows: DataFrame, build: Callable[..., bytes], *columns: str) -> DataFrame:
    """doc_id, content: build(doc_id, *values of columns) for each row.

    Rows are dealt out by doc_id first: a table of few row groups would be built, and then read, by as few tasks.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(batch.column(c).to_pylist() for c in ("doc_id", *columns)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([build(*v) for v in values], pa.binary())], ["doc_id", "content"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).repartition(tasks, "doc_id").mapInArrow(each, "doc_id bigint, content binary")


def gathered(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """One row for each key: doc_id and an array of structs in order. Spark combines by key; a task holds one document's rows."""
    item = F.struct(*order, *(c for c in columns if c not in order))
    return rows.groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def lines_content(text: str, font: str = "F1", size: float = 10.0) -> bytes:
    """One Tj for each line, from the top of the page down."""
    from quirelake.kernel.writer import ContentBuilder

    c = ContentBuilder().begin_text().font(font, size).leading(size * 1.2).move(36, 756)
    for i, line in enumerate(text.split("\n")):
        if i:
            c.next_line()
        if line:
            c.show(line.encode("latin-1", "replace"))
    return c.end_text().build()


FILTERS = ([], ["FlateDecode"], ["ASCIIHexDecode"], ["ASCII85Decode"], ["LZWDecode"], ["RunLengthDecode"], ["ASCII85Decode", "FlateDecode"])


def one_page(doc_id: int, text: str, filters: list[str] = (), packed: bool = False, encryption=None) -> bytes:
    from quirelake.kernel.writer import Builder

    b = Builder()
    b.page(lines_content(text or ""), list(filters))
    b.info(Title=f"Document {doc_id}", Author="quirelake")
    return b.build(packed, encryption)


def documents_as_files(docs: DataFrame, filters: str = "none", packed: bool = False, encryption: bool = False) -> DataFrame:
    """A file of one page for each document. filters: none, flate, or cycled (by doc_id). encryption: cycled by doc_id, user password "u<doc_id>"."""

    def build(doc_id, text):
        own = {"none": [], "flate": ["FlateDecode"]}.get(filters) if filters != "cycled" else FILTERS[int(doc_id) % len(FILTERS)]
        scheme = ("rc4-40", "rc4-128", "aes-128", "aes-256-r5")[int(doc_id) % 4]
        return one_page(int(doc_id), text, own, packed, (scheme, f"u{int(doc_id)}", "owner") if encryption else None)

    return made(docs, build, "text")


def turns_as_files(conversations: DataFrame) -> DataFrame:
    """A file for each conversation, a page for each turn, in a tree with a branch for each three pages."""

    def build(doc_id, items):
        from quirelake.kernel.writer import Builder

        b, branch = Builder(), None
        for i, item in enumerate(items):
            if i % 3 == 0:
                branch = b.branch()
            b.page(lines_content(item["text"] or ""), ["FlateDecode"], parent=branch)
        return b.build(packed=bool(int(doc_id) % 2))

    return made(gathered(conversations, "conv_id", ["turn", "role", "text"]), build, "items")
