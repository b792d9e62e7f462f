"""Naming an intermediate value inside a Column expression."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computing ``value`` once.

    A Column is a tree: using one twice copies it, and generated methods beyond 8 KB of
    byte code are not compiled by the JVM. Common subexpressions are only shared by Spark
    outside conditional branches.
    """
    return F.transform(F.array(value), body)[0]
