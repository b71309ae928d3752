"""Virtual tables: a user's module as a data source that Spark reads in parallel, with filters handed down to it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Values of one part.
PART = 1_000_000


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SeriesReader(DataSourceReader):
    """Integers from start to stop; bounds on the value narrow what is made."""

    def __init__(self, start: int, stop: int, step: int):
        self.start, self.stop, self.step = start, stop, step

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            on_value = getattr(f, "attribute", None) == ("value",) and isinstance(getattr(f, "value", None), int)
            if on_value and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.start = max(self.start, self.start + -(-(least - self.start) // self.step) * self.step)
            if on_value and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.stop = min(self.stop, f.value - isinstance(f, LessThan))
            if not on_value or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f  # left to Spark

    def partitions(self) -> list[InputPartition]:
        width = PART * self.step
        return [Range(low, min(low + width - self.step, self.stop)) for low in range(self.start, self.stop + 1, width)]

    def read(self, part: Range) -> Iterator[tuple]:
        import pyarrow as pa

        for low in range(part.low, part.high + 1, 65_536 * self.step):
            yield pa.RecordBatch.from_pydict({"value": pa.array(range(low, min(low + 65_536 * self.step, part.high + 1), self.step), pa.int64())})


class Series(DataSource):
    """``spark.read.format("series")`` with options start, stop and step."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "value long"

    def reader(self, schema) -> DataSourceReader:
        step = int(self.options.get("step", 1))
        if step < 1:
            raise ValueError("a series has a step of 1 or more")
        return SeriesReader(int(self.options.get("start", 0)), int(self.options["stop"]), step)


def register(spark: SparkSession, module: type[DataSource] = Series) -> None:
    """Makes a module's tables readable; filters are handed to it where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(module)
