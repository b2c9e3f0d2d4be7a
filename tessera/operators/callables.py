"""Injected Python callables over texts, in Arrow batches, with every row's failure kept apart from the others."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_PLAIN: dict[type[T.DataType], tuple[type, ...]] = {
    T.StringType: (str,), T.LongType: (int,), T.IntegerType: (int,), T.DoubleType: (float, int), T.BooleanType: (bool,),
}


def fitted(value: Any, kind: T.DataType, at: str = "result") -> Any:
    """value under a schema: missing and null fields are null where they may be, further ones are left out; a ValueError names
    the first place that does not fit. A whole number fits a double, true and false fit booleans only."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: an object is wanted")
        out = {}
        for f in kind.fields:
            inner = value.get(f.name)
            if inner is None and not f.nullable:
                raise ValueError(f"{at}.{f.name}: missing")
            out[f.name] = None if inner is None else fitted(inner, f.dataType, f"{at}.{f.name}")
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{at}: a list is wanted")
        if not kind.containsNull and None in value:
            raise ValueError(f"{at}[{value.index(None)}]: missing")
        return [None if x is None else fitted(x, kind.elementType, f"{at}[{i}]") for i, x in enumerate(value)]
    wanted = _PLAIN.get(type(kind))
    if wanted is None:
        raise TypeError(f"{at}: results can't be {kind.simpleString()}")
    if not isinstance(value, wanted) or (isinstance(value, bool) and bool not in wanted):
        raise ValueError(f"{at}: {kind.simpleString()} is wanted")
    if isinstance(kind, (T.LongType, T.IntegerType)) and not -(1 << (63 if isinstance(kind, T.LongType) else 31)) <= value < 1 << (63 if isinstance(kind, T.LongType) else 31):
        raise ValueError(f"{at}: too large")
    return float(value) if isinstance(kind, T.DoubleType) else value


def answered(call: Callable[[str], Any], text: str, kind: T.StructType) -> dict:
    """The callable's answer, an object or its JSON text, under the schema."""
    found = call(text)
    if isinstance(found, str):
        found = json.loads(found)
    return fitted(found, kind)


def _run(call: Callable[[str], Any], keep: list[str], text: str, kind: T.StructType, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for x in batch.column(text):
                value = error = None
                if x.is_valid:
                    try:
                        value = answered(call, x.as_py(), kind)
                    except Exception as e:  # any failure of the callable is its row's
                        error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values, schema.field("value").type), pa.array(errors, pa.string())], schema=schema)

    return run


def called(rows: DataFrame, text: str, call: Callable[[str], Any], result: str, keep: list[str] | None = None) -> DataFrame:
    """rows (of their columns those in keep, if given) with value, the callable's answer for the text under the schema that
    `result` gives as DDL, and error, why there is none ("type: message"). A null text is not asked: both are null. The
    callable is sent to the tasks, so it has to be serialisable; it sees one text at a time and may be asked again for a
    row of a lost task. Columns named value or error are replaced."""
    if not callable(call):
        raise TypeError("call has to be callable")
    kind = T.StructType.fromDDL(result)
    kept = [c for c in rows.columns if c.lower() not in {"value", "error"} and (keep is None or c in keep)]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("value", kind), T.StructField("error", T.StringType())])
    return rows.select(*dict.fromkeys([*kept, text])).mapInArrow(_run(call, kept, text, kind, to_arrow_schema(schema)), schema)


def in_order(answers: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, results, error): of each key all values in the order of the ordinals, or, if any failed, no results and the error
    of the first one by ordinal that did. What a key's answers take together is one row, as its text was."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col(ordinal)))
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("n"), "value")))
    rows = answers.groupBy(key).agg(first.alias("error"), F.transform(listed, lambda x: x["value"]).alias("results"))
    return rows.select(key, F.when(F.col("error").isNull(), F.col("results")).alias("results"), "error")


def raise_first(answers: DataFrame, key: str, ordinal: str) -> None:
    """Raise the first error by key and ordinal, if there is one."""
    worst = answers.where("error is not null").orderBy(key, ordinal).select(key, ordinal, "error").first()
    if worst is not None:
        raise RuntimeError(f"{key} {worst[0]}, part {worst[1]}: {worst[2]}")
