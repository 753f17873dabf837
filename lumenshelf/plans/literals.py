"""Tables of a query that exist as DataFrames and as SQL: small literal ones, and ones made of a given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import views


def sql_value(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return repr(v)


class Literal:
    """Rows under a DDL schema; `frame` and `cte` give them to either engine."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def cte(self) -> str:
        kinds = {"long": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean", "array<string>": "varchar[]", "array<double>": "double[]", "timestamp": "timestamp"}
        cols = [c.rsplit(" ", 1) for c in self.schema.split(", ")]
        casts = ", ".join(f"cast({n} as {kinds[k]}) as {n}" for n, k in cols)
        values = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in self.rows)
        return f"{self.name} as (select {casts} from (values {values}) v({', '.join(n for n, _ in cols)}))"


class Derived:
    """Rows that a select over one given table makes, as a text that both engines take.

    `{source}` names the table in the text; braces of the text itself are doubled.
    """

    def __init__(self, name: str, table: str, select: str):
        self.name, self.table, self.select = name, table, select

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.select, source=views.table(spark, sf_dir, self.table))

    def cte(self) -> str:
        return f"{self.name} as ({self.select.format(source=self.table)})"
