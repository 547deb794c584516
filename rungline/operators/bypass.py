"""Bypassed logic: findings over the branch tree of each rung.

Kinds: afi (a series with AFI), never-true (XIC and XIO of one operand in a series), empty-leg and nop-leg (a passive leg beside a leg with
a condition), always-true (two legs of one instruction each, XIC and XIO of one operand)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rung


#: What any finding needs: AFI, a contact and its opposite, NOP, or a leg without a call (nothing in parentheses between two marks).
_PAIR = (r"(?i)XIC *\(", r"(?i)XIO *\(")
_ANY = r"(?i:AFI|NOP) *\(|[\[,][^()\[\],]*+(?:[,\]]|$)"


def findings(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, node, operand, affected, operands. Rungs that can have no finding aren't parsed; nothing is shuffled."""
    may = F.col("txt").rlike(_ANY) | (F.col("txt").rlike(_PAIR[0]) & F.col("txt").rlike(_PAIR[1]))
    return units.where(may).select(*keys, F.explode(rung.parse_findings("txt")).alias("f")).select(*keys, "f.*")
