"""Row functions that may take their whole process down, run so that only the row at fault is lost."""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def answers(f: Callable[[dict], Any], rows: list[dict]) -> Iterator[tuple[Any, str]]:
    """(value, status) of each row in order. A forked child works through the rows; should it die, the row it was at is marked and another child goes on behind it."""
    at = 0
    while at < len(rows):
        read, write = os.pipe()
        child = os.fork()
        if not child:
            try:
                os.close(read)
                with os.fdopen(write, "wb") as pipe:
                    for row in rows[at:]:
                        try:
                            answer = f(row), "ok"
                        except Exception as e:  # the status says which; the other rows go on
                            answer = None, f"error:{type(e).__name__}"
                        pickle.dump(answer, pipe)
                        pipe.flush()
            finally:
                os._exit(0)
        os.close(write)
        try:
            with os.fdopen(read, "rb") as pipe:
                while at < len(rows):
                    try:
                        answer, alive = pickle.load(pipe), True
                    except (EOFError, pickle.UnpicklingError):
                        answer, alive = (None, "died"), False
                    at += 1
                    yield answer
                    if not alive:
                        break
        finally:
            os.waitpid(child, 0)


def isolated(df: DataFrame, f: Callable[[dict], Any], key: str, kind: str) -> DataFrame:
    """key, value (of type ``kind``) and status of every row: ``ok``, ``error:`` with the exception's name, or ``died``; without a value where it isn't ``ok``."""
    schema = T.StructType([df.schema[key], T.StructField("value", T.StructType.fromDDL(f"value {kind}")["value"].dataType), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                done = list(answers(f, part.to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, types.field(n).type) for n, c in zip(("value", "status"), zip(*done, strict=True), strict=True))], names=[key, "value", "status"])

    return df.mapInArrow(run, schema)
