"""Adjustment factors of corporate actions and the terms hidden in their remarks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Remark patterns (case-insensitive).
RATIO = r"(?i)ratio\s+of\s+(\d+(?:\.\d+)?)\s*:\s*(\d+(?:\.\d+)?)"
FACE_CHANGE = r"(?i)from\s+(?:r[se]\.?\s*)?(\d+(?:\.\d+)?)\s*(?:/-)?\s*to\s+(?:r[se]\.?\s*)?(\d+(?:\.\d+)?)"
PREMIUM = r"(?i)premium\s+of\s+(?:r[se]\.?\s*)?(\d+(?:\.\d+)?)"
FACE = r"(?i)shares?\s+of\s+(?:r[se]\.?\s*)?(\d+(?:\.\d+)?)"
NUMBERS = {
    "offered": (RATIO, 1), "held": (RATIO, 2), "old": (FACE_CHANGE, 1), "new": (FACE_CHANGE, 2), "face": (FACE, 1), "premium": (PREMIUM, 1),
}


def numbers(remark: Column) -> dict[str, Column]:
    """Each number that a remark can hold, or null where its pattern is absent; never a guess."""
    return {
        name: F.nullif(F.regexp_extract(remark, pattern, group), F.lit("")).try_cast("double")
        for name, (pattern, group) in NUMBERS.items()
    }


def split_factor(old_shares: Column, new_shares: Column) -> Column:
    return F.when((old_shares > 0) & (new_shares > 0), old_shares / new_shares)


def bonus_factor(free: Column, held: Column) -> Column:
    return F.when((free > 0) & (held > 0), held / (free + held))


def rights_factor(offered: Column, held: Column, subscription: Column, cum: Column) -> Column:
    """Theoretical ex-rights price over the cum-rights price; null unless dilutive."""
    valid = (offered > 0) & (held > 0) & (cum > 0) & (subscription >= 0) & (subscription < cum)
    return F.when(valid, ((held * cum + offered * subscription) / (held + offered)) / cum)


def dividend_factor(cum: Column, dividend: Column) -> Column:
    return F.when((cum > 0) & (dividend >= 0) & (dividend < cum), (cum - dividend) / cum)


def bonus_of(n: dict[str, Column]) -> Column:
    """A free shares for every B held."""
    return bonus_factor(n["offered"], n["held"])


def split_of(n: dict[str, Column]) -> Column:
    """Face value change only; a share ratio in the text is not read as a split."""
    return F.when((n["old"] > 0) & (n["new"] > 0), n["new"] / n["old"])


def rights_of(n: dict[str, Column]) -> dict[str, Column]:
    """offered, held and subscription price (face plus premium, or the one that is given)."""
    valid = (n["offered"] > 0) & (n["held"] > 0)
    return {
        "offered": F.when(valid, n["offered"]),
        "held": F.when(valid, n["held"]),
        "subscription": F.when(valid, F.coalesce(n["face"] + n["premium"], n["premium"], n["face"])),
    }


def bonus_from_remark(remark: Column) -> Column:
    return bonus_of(numbers(remark))


def split_from_remark(remark: Column) -> Column:
    return split_of(numbers(remark))


def rights_terms(remark: Column) -> dict[str, Column]:
    return rights_of(numbers(remark))
