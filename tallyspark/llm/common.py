"""Shared helpers of the corpus operators: tables, durable intermediate results, Python over texts."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..scratch import durable, scratch_root
from ..shipping import ship

__all__ = ["durable", "scratch_root", "table", "tidy", "slices", "over_texts", "col", "id_text", "span_digest"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run):
    """The same function of batches, which gives its memory back when its partition ends: Spark
    keeps Python workers for later stages, and the allocators keep what was freed."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


SLICE = 1 << 20  # bytes of text that Python works on together


def slices(batch: pa.RecordBatch, column: int):
    """A batch in parts of about ``SLICE`` bytes of a text column; a longer text is a part alone."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_pylist()
    at = 0
    while at < batch.num_rows:
        z, before = at + 1, ends[at - 1] if at else 0
        while z < batch.num_rows and ends[z] - before <= SLICE:
            z += 1
        yield batch.slice(at, z - at)
        at = z


def over_texts(df: DataFrame, start, made: str) -> DataFrame:
    """New columns ``made`` from the texts in the last column of ``df``, which they replace.

    ``start()`` runs once a partition and gives a function of a list of texts: it returns the
    rows that its values belong to (None: one each, in order) and the values by column. The
    other columns pass through Arrow as they are, so 64-bit ids stay whole beside nulls.
    """
    fields = StructType.fromDDL(made).fields
    types, names = [to_arrow_type(f.dataType) for f in fields], [*df.columns[:-1], *(f.name for f in fields)]

    def run(batches):
        judge = start()
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                rows, values = judge(part.column(last).to_pylist())
                own = [c if rows is None else c.take(pa.array(rows, pa.int64())) for c in part.columns[:last]]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(values, types))], names=names)

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields[:-1], *fields]))


def col(name: str) -> Column:
    """Column by its whole name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) under fixed names: other columns, whatever their names, can't clash."""
    ship(docs.sparkSession)
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))


def span_digest(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of structs (kind, s, e), by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), rank[c["kind"]].alias("r"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")
