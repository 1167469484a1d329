"""What the text operators share: reading tables, batching, shared storage, row identity."""

from __future__ import annotations

import gc
import sys
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

# Functions sent to executors travel by value, so executors need not find this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules["rowloom.llm"])

#: Texts are handed to the vectorised code in slabs of at most this many characters (or one text, if longer).
SLAB_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with reliable storage in ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, compact, and no lineage behind it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so when the driver has collected its garbage."""
    for _ in range(2):  # the first time frees what Python held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; columns of any other name cannot clash. Null texts become empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


#: A null doc_id counts as the least number.
FIRST = -(2**63)
#: Rows are the same document if doc_id and text agree. Neither column is ever null, so that joins lose no row.
KEY = ["doc", "row_key"]


def with_key(docs: DataFrame) -> DataFrame:
    """``doc`` (doc_id as a number) and ``row_key`` (hash of the text), of which two together identify a row."""
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(FIRST)), "row_key": F.xxhash64("text")})


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with all its columns and those of KEY, under the returned names, which no other column has."""
    have, names = {c.lower() for c in docs.columns}, []
    for name in KEY:
        while name in have:
            name += "_"
        names.append(name)
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST))
    return docs.withColumns({names[0]: doc, names[1]: F.xxhash64(F.coalesce(docs["text"], F.lit("")))}), names


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLAB_CHARS) -> Iterator[pa.Table]:
    """Regroup record batches into tables of bounded text volume."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        for i, n in enumerate(lengths):
            n = n or 0
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def emit(columns: dict, schema: pa.Schema, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns, schema=schema).to_batches(max_chunksize=rows)
