"""Registered queries of the fund operators and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators import ALL
from navloom.plans.fixtures import INPUTS, fund_tables
from navloom.plans import twins
from navloom.plans.text import Operator, written
from navloom.sources import queries as sources


def selected(sql: str) -> list[str]:
    """Names of the columns that a text selects at its end."""
    depth, start, parts, last = 0, 0, [], 0
    for m in re.finditer(r"[()]|,|\bselect\b|\bfrom\b", sql):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth:
            continue
        elif m[0] == "select":
            parts, last, start = [], m.end(), 1
        elif start and m[0] in (",", "from"):
            parts.append(sql[last : m.start()].strip())
            last, start = m.end(), int(m[0] == ",")
    return [p.split()[-1].split(".")[-1] for p in parts]


#: Columns that hold dates; registered queries give them as text, so that every engine writes them alike.
DATES = {"ts", "week", "month", "month_end", "as_of", "last_ts", "target", "at_ts", "start", "nearest"}


def dates_of(op: Operator) -> list[str]:
    return [c for c in selected(op.sql) if c in DATES]


def query(op: Operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(fund_tables(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in dates_of(op)})

    run.__name__, run.__doc__ = op.name, op.doc
    return run


QUERIES = {**sources.QUERIES, **{name: query(op) for name, op in ALL.items()}}


def oracle(op: Operator) -> str:
    text = op.text("duckdb", {k: written(v, "duckdb") for k, v in INPUTS.items()})
    dates = ", ".join(f"cast({c} as varchar) as {c}" for c in dates_of(op))
    return f"select * replace ({dates}) from ({text}) q" if dates else text


#: SQL written apart where there is some, else the operator's text in DuckDB's dialect.
ORACLE_SQL = {**sources.ORACLE_SQL, **{name: oracle(op) for name, op in ALL.items()}, **twins.SQL}
