"""A data source in Python: days between two dates, one partition for each year."""

from __future__ import annotations

import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Year(InputPartition):
    def __init__(self, first: datetime.date, last: datetime.date) -> None:
        self.first, self.last = first, last


class CalendarReader(DataSourceReader):
    def __init__(self, first: datetime.date, last: datetime.date) -> None:
        self.first, self.last = first, last

    def partitions(self) -> list[Year]:
        years = range(self.first.year, self.last.year + 1)
        return [Year(max(self.first, datetime.date(y, 1, 1)), min(self.last, datetime.date(y, 12, 31))) for y in years]

    def read(self, partition: Year):
        for i in range((partition.last - partition.first).days + 1):
            day = partition.first + datetime.timedelta(i)
            yield day, day.isoweekday(), day.isoweekday() > 5


class Calendar(DataSource):
    """spark.read.format("calendar").options(first="2024-01-01", last="2024-12-31")"""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, weekday int, weekend boolean"

    def reader(self, schema) -> CalendarReader:
        return CalendarReader(*(datetime.date.fromisoformat(self.options[k]) for k in ("first", "last")))
