"""Plans as SQL steps: named subqueries that Catalyst plans as one; the dialect holds hashing, percentiles and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Spark:
    @staticmethod
    def hashed(*parts: object) -> str:
        """A number from 0 to 2**32 - 1 from md5 of the parts: the same draw on any engine, partitioning or retry."""
        return f"cast(conv(substr(md5(concat_ws(':', {', '.join(f'cast({p} as string)' for p in parts)})), 1, 8), 16, 10) as bigint)"

    @staticmethod
    def quantile(x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    @staticmethod
    def series(n: object, name: str) -> str:
        return f"(SELECT id AS {name} FROM range({n}))"

    @staticmethod
    def points(array: str, rest: str, names: str, table: str) -> str:
        return f"SELECT {rest}, pos AS pt, cast(v AS double) AS v FROM {table} LATERAL VIEW posexplode({array}) AS pos, v"


Steps = list[tuple[str, str]]


def values(rows, names: str) -> str:
    """A table of numbers written out."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(int(v)) for v in row) + ")" for row in rows) + f") AS t({names})"


def _text(steps: Steps) -> str:
    *before, (_, last) = steps
    return (f"WITH {', '.join(f'{n} AS ({q})' for n, q in before)} " if before else "") + last


def run(spark: SparkSession, steps: Steps, **inputs: DataFrame) -> DataFrame:
    """The last step's rows; {name} in a step is the DataFrame of that name."""
    return spark.sql(_text(steps), **inputs)
