"""Small helpers of the operators that run Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text handled at once inside a batch, so that what is derived from it stays small: bytes, and rows.
SLICE_BYTES = 512 << 10
SLICE_ROWS = 512


class Memo(dict):
    """A dictionary that computes what it lacks and forgets everything at `bound` entries.

    Long keys are computed again each time, so that the memory has a bound too.
    """

    def __init__(self, compute: Callable, bound: int = 600_000, longest: int = 48):
        super().__init__()
        self.compute, self.bound, self.longest = compute, bound, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[key] = value
        return value


def text_column() -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col("text"), F.lit(""))


def named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def fresh_name(documents: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the documents has."""
    taken = {c.lower() for c in documents.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE_ROWS rows and SLICE_BYTES of text; a longer text is alone."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for i, length in enumerate(lengths):
            if i > start and (size + length > SLICE_BYTES or i - start == SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


def annotate(
    documents: DataFrame, keep: list[str], new: str, prepare: Callable[[], Callable[[list[str]], list]]
) -> DataFrame:
    """The kept columns and the new ones (`new` is their schema), computed from whole texts.

    `prepare` runs once per task and returns a function from texts (null as empty) to the new columns.
    One pass, no shuffle; only the kept columns and the text are read.
    """
    # Under numbers inside, since a name may hold dots.
    columns = keep if "text" in keep else [*keep, "text"]
    inner = ["text" if c == "text" else f"c{i}" for i, c in enumerate(columns)]
    read = documents.select(*[c.alias(n) for c, n in zip(named(columns), inner)])
    added = T.StructType.fromDDL(new).fields
    schema = T.StructType(
        [*read.schema.fields[: len(keep)], *[T.StructField(f"n{i}", f.dataType) for i, f in enumerate(added)]]
    )

    def run(batches):
        compute = prepare()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            arrays = [batch.column(c) for c in inner[: len(keep)]]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a) for a in compute(texts)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return read.mapInArrow(run, schema).toDF(*keep, *[f.name for f in added])


def kept_rows(documents: DataFrame, prepare: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """The rows for whose text the prepared function is true, with the columns they had."""
    name = fresh_name(documents, "kept")
    judged = annotate(
        documents, documents.columns, f"`{name}` BOOLEAN", lambda: lambda texts, f=prepare(): [f(texts)]
    )
    return judged.where(F.col(name)).select(*named(documents.columns))
