"""Classifiers and small text rules."""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehold import conventions as cv


def bare(pattern: str) -> str:
    """A whole-text pattern without its anchors, for ``re.fullmatch``."""
    return pattern.removeprefix("^").removesuffix(r"\z")


def outcome_class(o: Column) -> Column:
    return (F.when(o.isin(*cv.OUTCOME_GOOD), "good").when(o.isin(*cv.OUTCOME_WARN), "warn")
            .when(o.isin(*cv.OUTCOME_BAD), "bad").otherwise("none"))


def id_like(v: Column) -> Column:
    """What a value looks like if it is an identifier, else NULL."""
    return (F.when(v.rlike(cv.UUID), "a UUID").when(v.rlike(cv.ULID), "a ULID")
            .when(v.rlike(cv.HEX_ID), "a hash or trace id").when(v.rlike(cv.ITEM_LIKE), "an item key"))


def is_email(v: Column) -> Column:
    """True when the whole value is an address; a sentence holding one is not."""
    return v.rlike(cv.EMAIL)


def clean_home(home: str | None) -> str | None:
    """An absolute folder without a trailing or doubled slash; None for the root or a relative one."""
    if not home or not home.startswith("/"):
        return None
    parts: list[str] = []
    for p in home.split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/" + "/".join(parts) if parts else None


def under_home(v: Column, home: str | None) -> Column:
    home = clean_home(home)
    if home is None:
        return F.lit(False)
    return (v == home) | F.startswith(v, F.lit(home + "/"))


def account_hash(v: Column, key: bytes) -> Column:
    """``<key id>:<hex HMAC-SHA-256 of v>``; the pads are made here, so no key reaches a Python task."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    key_id = hmac.new(key, cv.ACCOUNT_KEY_LABEL.encode(), hashlib.sha256).hexdigest()[:8]
    first = F.unhex(F.sha2(F.concat(F.lit(inner), v.cast("binary")), 256))
    return F.concat(F.lit(key_id + ":"), F.sha2(F.concat(F.lit(outer), first), 256))


def usable_name(s: Column) -> Column:
    return F.when(s.rlike(cv.USABLE_NAME), s).otherwise(cv.UNUSABLE)


def label_key(l: Column) -> Column:
    return F.split_part(l, F.lit(":"), F.lit(1))


def label_value(l: Column) -> Column:
    return F.substr(l, F.instr(l, ":") + F.lit(1))


def valid_label(l: Column) -> Column:
    """True for ``key:value`` with a lower-case key and a value of the allowed characters."""
    return (F.instr(l, ":") > 0) & label_key(l).rlike(cv.LABEL_KEY) & label_value(l).rlike(cv.LABEL_VALUE)


def check_label(label: str) -> None:
    """The same rule for an argument, before a query runs."""
    key, colon, value = label.partition(":")
    if not colon:
        raise ValueError(f"label {label!r}: write it key:value")
    if not re.fullmatch(bare(cv.LABEL_KEY), key):
        raise ValueError(f"label {label!r}: a key starts with a-z and holds up to 32 of a-z, 0-9, _ . -")
    if not re.fullmatch(bare(cv.LABEL_VALUE), value):
        raise ValueError(f"label {label!r}: a value is 1 to 64 of A-Z, a-z, 0-9, . _ / # - and has no leading /")


def registry_version(v: Column) -> Column:
    """A SemVer version without its build metadata."""
    return F.split_part(v, F.lit("+"), F.lit(1))


def source_name(rel: Column) -> Column:
    """``runs/r1/a.open.jsonl`` as ``runs.r1.a``: the same while a file is open and once closed."""
    return F.regexp_replace(F.regexp_replace(rel, r"(\.open)?\.jsonl$", ""), "/", ".")


def body_excerpt(b: Column) -> Column:
    return F.when(F.length(b) > 120, F.concat(F.substring(b, 1, 117), F.lit("..."))).otherwise(b)


def excerpt(s: Column) -> Column:
    """One line of at most 160 characters; ``(none)`` when nothing is left."""
    flat = F.btrim(F.regexp_replace(s, r"\s+", " "))
    short = F.when(F.length(flat) > 160, F.concat(F.substring(flat, 1, 157), F.lit("..."))).otherwise(flat)
    return F.when(short == "", F.lit("(none)")).otherwise(short)


def canary_kinds(cmd: Column) -> Column:
    return F.regexp_extract_all(cmd, F.lit(r"@canary:([A-Za-z]+)"), F.lit(1))


def plant_canaries(cmd: Column, planted: dict[str, str]) -> Column:
    """Put each planted string where the text names its kind; an unknown kind becomes nothing."""
    out = cmd
    for kind, token in planted.items():
        out = F.regexp_replace(out, rf"@canary:{re.escape(kind)}(?![A-Za-z])",
                               token.replace("\\", "\\\\").replace("$", r"\$"))
    return F.regexp_replace(out, r"@canary:[A-Za-z]+", "")
