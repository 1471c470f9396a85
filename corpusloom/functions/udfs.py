"""Where callers put functions of their own: models, fetchers, table readers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.tables import table_rows


def model_column(model: Callable[[list[str]], list[str | None]]) -> Callable[[Column], Column]:
    """A batch function of texts as a column function; after an exception each text of the batch is tried alone, and those that raise again become null."""

    def alone(text: str) -> str | None:
        try:
            return model([text])[0]
        except Exception:  # a model is somebody else's code
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = texts.fillna("").tolist()
        try:
            return pd.Series(model(own), dtype="object")
        except Exception:
            return pd.Series([alone(t) for t in own], dtype="object")

    return run


@F.udtf(returnType=StructType([StructField("row", IntegerType()), StructField("cell", IntegerType()), StructField("text", StringType()), StructField("span", IntegerType())]))
class TableCells:
    """``table_cells(html)``: every cell of an HTML table."""

    def eval(self, html: str):
        yield from table_rows(html)


def register(spark: SparkSession) -> None:
    """Make the table function known to SQL."""
    spark.udtf.register("table_cells", TableCells)
