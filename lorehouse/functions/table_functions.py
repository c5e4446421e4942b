"""Table functions for users of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.text import chunk_text


def register_chunker(spark: SparkSession, name: str = "chunk_recursive", key_type: str = "bigint", size: int = 300, overlap: int = 50, max_chars: int = 6000) -> None:
    """Makes chunk_recursive known to SQL: select * from chunk_recursive(table(select id, text from pages) partition by id) gives (key, chunk_index, chunk_text) of a table of a key and a text, in that order. Texts are cut one by one, so that a partition of the argument may hold any number of them."""

    class Chunker:
        def eval(self, row: Row) -> Iterator[tuple]:
            for n, chunk in enumerate(chunk_text(row[1], size, overlap, max_chars)):
                yield row[0], n, chunk

    spark.udtf.register(name, udtf(Chunker, returnType=f"key {key_type}, chunk_index int, chunk_text string"))
