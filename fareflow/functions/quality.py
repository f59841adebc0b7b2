"""Q9 ``quality_report``: the validator re-aimed at whole tables.

The reference's validator collects ``field -> message`` for one request and
answers the first message.  Here a rule set is applied to every row at once:
per row the failing fields (in rule order), the first error message and a
has-errors flag; and per field the number of violations over the table.
All rules are Column expressions from ``rules.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

# (field, check builder, message) - messages are ours (the reference's are
# presentation text); check builders return a "passes" Column.
Rule = tuple[str, Callable[[Column], Column], str]

CONTACT_RULES: list[Rule] = [
    ("full_name", rules.required, "full_name is required"),
    ("email", rules.valid_email, "email is missing or invalid"),
    ("phone_number", rules.valid_phone, "phone_number is missing or invalid"),
]


def quality_report(df: DataFrame, key: str, rule_set: list[Rule] = CONTACT_RULES) -> DataFrame:
    """Per row: ``error_fields`` (failing fields in rule order), ``errors``
    (the validator's field -> message map, as JSON text), ``first_error``
    (message of the first failure) and ``has_errors``."""
    failures = F.array(*[F.when(~check(F.col(field)), F.struct(F.lit(field).alias("field"), F.lit(msg).alias("message")))
                         for field, check, msg in rule_set])
    failures = F.filter(failures, lambda x: x.isNotNull())
    return (df.select(key, failures.alias("_f"))
            .select(key, F.transform("_f", lambda x: x["field"]).alias("error_fields"),
                    F.to_json(F.map_from_entries("_f")).alias("errors"),
                    F.try_element_at("_f", F.lit(1))["message"].alias("first_error"),
                    (F.size("_f") > 0).alias("has_errors")))


def quality_summary(df: DataFrame, rule_set: list[Rule] = CONTACT_RULES) -> DataFrame:
    """Per field: rows checked and violations (one pass, one aggregate row
    per task before the final merge)."""
    aggs = []
    for field, check, _ in rule_set:
        aggs.append(F.count_if(~check(F.col(field))).alias(field))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    stack = ", ".join(f"'{f}', `{f}`" for f, _, _ in rule_set)
    return wide.selectExpr("_rows as rows_checked", f"stack({len(rule_set)}, {stack}) as (field, violations)")
