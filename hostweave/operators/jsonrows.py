"""JSON rows and page envelopes."""

from pyspark.sql import DataFrame, functions as F, types as T

_IGNORE_NULLS = {"ignoreNullFields": "true"}


def to_json_rows(df: DataFrame, omit_empty: list[str] = [], name: str = "json") -> DataFrame:
    """One JSON object per row; columns in ``omit_empty`` leave out zero and '' values."""

    def value(field: T.StructField):
        column = F.col(field.name)
        if field.name not in omit_empty:
            return column
        empty = "" if isinstance(field.dataType, T.StringType) else 0
        return F.nullif(column, F.lit(empty)).alias(field.name)

    row = F.struct(*[value(f) for f in df.schema.fields])
    return df.select(F.to_json(row, _IGNORE_NULLS).alias(name))


def page_envelope(page_rows: DataFrame, meta: DataFrame, order: list[str]) -> DataFrame:
    """One JSON object with the rows of a page under ``data`` and ``meta`` beside it.

    For pages cut by a limit: their rows are gathered into one value. A full list has no meta;
    it is written with :func:`to_json_rows`, one object per row.
    """
    keyed = page_rows.select(F.struct(*order, F.struct(*page_rows.columns).alias("_row")).alias("_r"))
    rows = keyed.agg(
        F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_row"]).alias("data")
    )
    zero_free = F.struct(
        *[F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("total", "limit", "offset")]
    )
    header = meta.select(F.when(F.col("limit").isNotNull(), zero_free).alias("meta")).scalar()
    return rows.select(F.to_json(F.struct("data", header.alias("meta")), _IGNORE_NULLS).alias("json"))
