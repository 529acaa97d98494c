"""Columns of any name: schemas as objects and not as text, new columns in place of old ones of their name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less the columns that new ones of these names replace (names are compared as Spark does, in any case)."""
    gone = {n.lower() for n in names}
    return docs.select(*[col(c) for c in docs.columns if c.lower() not in gone])


def mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], **new: str) -> DataFrame:
    """docs with new columns, given by name and type; ``run`` gives the new arrays of each batch. A map over the rows.

    Names are set aside on the way, as Spark's own map stops at some.
    """
    new = dict(new)
    names = [f"c{i}" for i in range(len(docs.columns) + len(new))]
    kinds = [f.dataType for f in docs.schema.fields] + [_TYPES[t] for t in new.values()]
    old = len(docs.columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield b

        held: list[pa.RecordBatch] = []
        for arrays in run(kept()):
            yield pa.RecordBatch.from_arrays([*held.pop(0).columns, *arrays], names)

    out = docs.toDF(*names[:old]).mapInArrow(whole, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
    return out.toDF(*docs.columns, *new)
