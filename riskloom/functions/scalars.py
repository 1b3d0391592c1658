"""Small scalar column functions: hashes, status, tiers, ledger encodings,
deterministic sampling and profile defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import (RISK_THRESHOLD, STATUS_ACCEPTED, STATUS_ROLLBACK,
                      TIER_LOW_BELOW, TIER_MEDIUM_BELOW)


def commit_hash(code: Column) -> Column:
    """First 16 hex digits of SHA-256 over the UTF-8 text."""
    return F.substring(F.sha2(code, 256), 1, 16)


def risk_percentage(score: Column) -> Column:
    return score * F.lit(100.0)


def risk_status(score: Column) -> Column:
    return F.when(score < F.lit(RISK_THRESHOLD), F.lit(STATUS_ACCEPTED)).otherwise(F.lit(STATUS_ROLLBACK))


def risk_tier(pct: Column) -> Column:
    return (F.when(pct < F.lit(TIER_LOW_BELOW), F.lit("Low"))
            .when(pct < F.lit(TIER_MEDIUM_BELOW), F.lit("Medium"))
            .otherwise(F.lit("High")))


def mock_tx_hash(commit_hash_col: Column, pct: Column, status: Column) -> Column:
    """sha256(hash || shortest float text of pct || status)[:16]."""
    return F.substring(F.sha2(F.concat(commit_hash_col, pct.cast("string"), status), 256), 1, 16)


def ledger_payload(commit_hash_col: Column, pct: Column, status: Column) -> Column:
    """0x + hash right-padded to 64 + status byte + clamped integer score byte."""
    score_byte = F.least(F.greatest(pct.cast("int"), F.lit(0)), F.lit(100))
    return F.concat(
        F.lit("0x"), F.rpad(commit_hash_col, 64, "0"),
        F.when(status == F.lit(STATUS_ACCEPTED), F.lit("01")).otherwise(F.lit("00")),
        F.lpad(F.lower(F.hex(score_byte)), 2, "0"))


def hash_draw(commit_hash_col: Column) -> Column:
    """Replayable uniform draw in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(commit_hash_col, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def profile_username(meta_username: Column, email: Column) -> Column:
    """metadata name, else the e-mail local part, else ``user``."""
    return F.coalesce(F.nullif(meta_username, F.lit("")),
                      F.nullif(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("")),
                      F.lit("user"))


def strip_text(c: Column) -> Column:
    """Python ``str.strip`` for the Unicode whitespace set."""
    ws = r"[\s\x1C-\x1F]"
    return F.regexp_replace(c, F.lit(r"(?U)^" + ws + r"+|" + ws + r"+\z"), F.lit(""))


def is_blank(code: Column) -> Column:
    """True when ``code.strip()`` would be empty (or code is null)."""
    return code.isNull() | ~code.rlike(r"(?U)[^\s\x1C-\x1F]")


def fmt2(x: Column) -> Column:
    """Two-decimal text rounded on the exact binary value, half to even
    (Python's ``%.2f``); ``format_string`` rounds the shortest decimal
    form half-up instead (0.725 -> 0.73)."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))
