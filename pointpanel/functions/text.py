"""Text keys: names, prompts and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates the words of a name.
NOT_A_WORD = r"[^\p{L}\p{Nd}]+"


def concept_key(text: Column) -> Column:
    """Lower case, runs of other than letters and digits become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), NOT_A_WORD, "_"), F.lit("_"))


def prompt_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))


def content_key(text: Column, snapshot_id: Column) -> Column:
    """First 16 bytes of the SHA-256 in hex, then the snapshot."""
    return F.concat(F.substring(F.sha2(text, 256), 1, 32), F.lit(":"), snapshot_id.cast("string"))
