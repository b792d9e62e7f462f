"""Registering the package's Python data sources."""

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource


def register_source(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a source whose code travels with it.

    The worker that plans a streaming source does not see the application's Python files,
    so the source's module is pickled by value: executors need only Python and pyarrow.
    """
    cloudpickle.register_pickle_by_value(sys.modules[source.__module__])
    spark.dataSource.register(source)
