"""Jobs whose failures stay with the rows that caused them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavetally.operators.pairing import INFERENCE_ERROR, as_list, refuse_clash

Work = Callable[[pa.Table], pa.Table]


def isolated(work: Work, schema: str | T.StructType, key: str | Sequence[str] = "sample_idx", rows: int = 64):
    """A job for ``infer`` or ``decode`` that runs ``work`` and goes on where it raises.

    ``work`` takes a table of requests and returns one with the columns of ``schema``, which holds the ``key``. It is
    given ``rows`` requests at a time. If it raises, the portion is halved until the rows at fault stand alone; each of
    these gets a row with its key, NULL predictions, and the message in ``inference_error``. All other rows keep their
    predictions, so ``work`` must not depend on which rows come together. Only exceptions of Python are caught: a lost
    executor is Spark's to retry.
    """
    on = as_list(key)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    refuse_clash(fields.names, [INFERENCE_ERROR])
    absent = [k for k in on if k not in fields.names]
    if absent:
        raise ValueError(f"the schema lacks the key columns {absent}")
    with_error = T.StructType([*fields, T.StructField(INFERENCE_ERROR, T.StringType())])
    arrow = to_arrow_schema(with_error)

    def attempt(requests: pa.Table) -> Iterator[pa.Table]:
        try:
            done = work(requests).select(fields.names)
            no_error = pa.nulls(done.num_rows, pa.string())
            yield done.append_column(INFERENCE_ERROR, no_error).cast(arrow)
            return
        except Exception as error:  # noqa: BLE001 - the user's code may raise anything
            if requests.num_rows <= 1:
                message = f"{type(error).__name__}: {error}"
                columns = [
                    requests.column(f.name) if f.name in on
                    else pa.array([message] if f.name == INFERENCE_ERROR else [None], f.type)
                    for f in arrow
                ]
                yield pa.table(columns, schema=arrow)
                return
        half = requests.num_rows // 2
        yield from attempt(requests.slice(0, half))
        yield from attempt(requests.slice(half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                for done in attempt(pa.Table.from_batches([batch.slice(start, rows)])):
                    yield from done.combine_chunks().to_batches()

    def job(requests: DataFrame) -> DataFrame:
        return requests.mapInArrow(run, with_error)

    return job
