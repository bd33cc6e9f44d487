"""Schemas from column names: no inference, one rule per name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import types as T

from riskframe.spec import CARD_PAYMENTS, IDENTITY_TEXT_FIELDS, TableSpec

# Which columns of the two raw tables are numbers.
TRANSACTION_NUMBER = re.compile(r"[CDV]\d+")
IDENTITY_TEXT = frozenset((*IDENTITY_TEXT_FIELDS, "DeviceType", "DeviceInfo"))


def normalise_header(columns: Sequence[str]) -> list[str]:
    """``id-01`` and ``id_01`` name the same column; the underscore form is used."""
    return [re.sub(r"^id-(\d+)$", r"id_\1", c) for c in columns]


def transaction_schema(columns: Sequence[str], spec: TableSpec = CARD_PAYMENTS) -> T.StructType:
    doubles = {spec.amount, *spec.distances}

    def kind(name: str) -> T.DataType:
        if name in (spec.id, spec.time):
            return T.LongType()
        if name == spec.label:
            return T.IntegerType()
        if name in doubles or TRANSACTION_NUMBER.fullmatch(name):
            return T.DoubleType()
        return T.StringType()

    return T.StructType([T.StructField(c, kind(c), True) for c in columns])


def identity_schema(columns: Sequence[str], spec: TableSpec = CARD_PAYMENTS) -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name == spec.id:
            return T.LongType()
        number = name.startswith(spec.identity_prefix) and name not in IDENTITY_TEXT
        return T.DoubleType() if number else T.StringType()

    return T.StructType([T.StructField(c, kind(c), True) for c in columns])
