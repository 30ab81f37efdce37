"""Detection from SQL: the table function ``scan_pii(text)``, for ad-hoc use. Plans use the column expressions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspan.functions import patterns as P


class ScanPii:
    """type, start, end, value of each regex hit of a text."""

    def __init__(self):
        self.patterns = {kind: re.compile(pattern) for kind, pattern in P.REGEX_PATTERNS.items()}
        self.context = re.compile("|".join(f"(?:{c})" for c in P.ACCOUNT_ID_CONTEXT))

    def eval(self, text: str):
        for kind, pattern in self.patterns.items():
            for m in pattern.finditer(text or ""):
                account = kind == "CREDIT_CARD" and len(m[0]) == P.ACCOUNT_ID_LENGTH and self.context.search(text[: m.start()])
                if not account:
                    yield kind, m.start(), m.end(), m[0]


def register(spark: SparkSession) -> None:
    spark.udtf.register("scan_pii", F.udtf(ScanPii, returnType="type string, start int, end int, value string"))
