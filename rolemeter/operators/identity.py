"""What tells documents apart.

An id may repeat or be null; every row asks for itself. `doc_key` is a row's own number, given when
the rows are stored, so that whatever is computed of them meets again by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemeter.operators.layout import stored

DOC_KEY = "doc_key"


def identified(rows: DataFrame, purpose: str = "resumes") -> DataFrame:
    """The rows, stored, with a `doc_key` of their own; as they are if they have one."""
    if DOC_KEY in rows.columns:
        return rows
    return stored(rows.withColumn(DOC_KEY, F.monotonically_increasing_id()), purpose)


def document_columns(rows: DataFrame) -> list[str]:
    """The columns that name the document of a row: its key, if it has one, its id and its role."""
    return [c for c in (DOC_KEY, "resume_id", "target_role") if c in rows.columns]


def join_documents(rows: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Rows with the facts about their document: by its key where both have it, else by id and role, null equal to null."""
    if DOC_KEY in rows.columns and DOC_KEY in facts.columns:
        return rows.join(facts.drop("resume_id", "target_role"), DOC_KEY, how)
    names = ["resume_id", "target_role"]
    renamed = facts.drop(DOC_KEY).withColumnsRenamed({c: f"_{c}" for c in names})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    return rows.join(renamed, same, how).drop(*[f"_{c}" for c in names])
