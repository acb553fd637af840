"""A data source in Python over a table's parquet files, by row groups: batch reads with pushed filters, and a stream.

    spark.read.format("row_groups").options(path=..., columns="a,b").load()

Paths are opened by pyarrow, so executors must be able to open them: a shared folder, or a store that pyarrow knows.
Filters on numbers, strings and nulls are evaluated while reading, and row groups that their statistics rule out are no
partition at all; what can't be pushed is left to Spark. A stream takes row groups in the order of file names, `groups` a batch; files
whose names come later may be added while it runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

COMPARISONS = {D.EqualTo: "__eq__", D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}


def push_filters(spark: SparkSession) -> None:
    """Let Spark hand filters to sources in Python. It reads the setting when a plan is made, which is after a query returns, so it stays."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def expression(f: D.Filter) -> ds.Expression | None:
    """A filter for pyarrow; None if it has none here (nested columns, other kinds of filters or values)."""
    if isinstance(f, D.Not):
        inner = expression(f.child)
        return None if inner is None else ~inner
    if len(f.attribute) != 1:
        return None
    column = ds.field(f.attribute[0])
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return column.is_null() if isinstance(f, D.IsNull) else column.is_valid()
    if isinstance(f, D.In):
        return column.isin(list(f.value)) if all(isinstance(v, (int, float, str)) for v in f.value) else None
    if type(f) in COMPARISONS and isinstance(f.value, (int, float, str)):
        return getattr(column, COMPARISONS[type(f)])(f.value)
    if isinstance(f, D.StringStartsWith):
        return pc.starts_with(column, f.value)
    return None


class Group(D.InputPartition):
    """A row group of a file."""

    def __init__(self, path: str, number: int) -> None:
        self.path, self.number = path, number


def groups_of(path: str, condition: ds.Expression | None = None) -> list[Group]:
    """The row groups of a file or folder that may hold rows of the condition, by file name and place."""
    table = ds.dataset(path, format="parquet")
    pieces = [g for f in table.get_fragments(condition) for g in f.split_by_row_group(condition)]
    return [Group(g.path, g.row_groups[0].id) for g in sorted(pieces, key=lambda g: (g.path, g.row_groups[0].id))]


def rows_of(path: str, group: Group | None, columns: list[str], condition: ds.Expression | None = None) -> Iterator[pa.RecordBatch]:
    if group is None:  # what Spark reads where there are no partitions
        return
    whole = ds.dataset(path, format="parquet")
    fragment = whole.format.make_fragment(group.path, whole.filesystem, row_groups=[group.number])
    for batch in fragment.to_batches(schema=whole.schema, columns=columns, filter=condition, use_threads=False):
        if batch.num_rows:
            yield batch


class RowGroupReader(D.DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.condition = path, columns, None

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        known = []
        for f in filters:
            e = expression(f)
            if e is None:
                yield f
            else:
                known.append(e)
        self.condition = reduce(lambda a, b: a & b, known) if known else None

    def partitions(self) -> list[Group]:
        return groups_of(self.path, self.condition)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition, self.columns, self.condition)


class RowGroupStream(D.DataSourceStreamReader):
    """An offset is the number of row groups read so far."""

    def __init__(self, path: str, columns: list[str], most: int) -> None:
        self.path, self.columns, self.most, self.at = path, columns, most, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"groups": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.most, len(groups_of(self.path)))
        return {"groups": self.at}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.at = max(self.at, end["groups"])  # after a restart
        return groups_of(self.path)[start["groups"] : end["groups"]]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition, self.columns)


class RowGroups(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def _columns(self) -> list[str]:
        there = ds.dataset(self.options["path"], format="parquet").schema.names
        return [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else there

    def schema(self) -> StructType:
        whole = ds.dataset(self.options["path"], format="parquet").schema
        return from_arrow_schema(pa.schema([whole.field(c) for c in self._columns()]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(self.options["path"], self._columns())

    def streamReader(self, schema: StructType) -> RowGroupStream:  # noqa: N802
        return RowGroupStream(self.options["path"], self._columns(), int(self.options.get("groups", "8")))
