"""The same functions in SQL: overlap_count(text, pattern), and the table function occurrences(text, pattern)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Occurrences:
    """Rows (pos bigint) of each occurrence; a null text or pattern has none."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple[int]]:
        if text is None or pattern is None:
            return
        if pattern == "":
            yield from ((i,) for i in range(len(text) + 1))
            return
        at = text.find(pattern)
        while at >= 0:
            yield (at,)
            at = text.find(pattern, at + 1)


#: Inlined by Catalyst: the pattern may be a column. Quoting is that of functions.text.quoted.
OVERLAP_COUNT = r"""
CREATE OR REPLACE TEMPORARY FUNCTION overlap_count(t STRING, p STRING) RETURNS BIGINT
RETURN CASE WHEN p = '' THEN CAST(length(t) + 1 AS BIGINT)
  ELSE CAST(regexp_count(t, concat(r'(?=\Q', replace(p, r'\E', r'\E\\E\Q'), r'\E)')) AS BIGINT) END
"""


def register(spark: SparkSession) -> None:
    """Make overlap_count and occurrences known to a session: SELECT ... FROM docs, LATERAL occurrences(text, 'issi')."""
    spark.sql(OVERLAP_COUNT)
    spark.udtf.register("occurrences", F.udtf(Occurrences, returnType="pos: bigint"))
