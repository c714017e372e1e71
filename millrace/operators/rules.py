"""Rules by name: text rewrites, quality profiles, and the identity of what is registered."""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

_RULES: dict[str, tuple[str, str]] = {}
_PROFILES: dict[str, T.Quality] = {}


def register_rule(name: str, pattern: str, replacement: str) -> None:
    _RULES[name] = (pattern, replacement)


def register_quality_profile(name: str, profile: T.Quality) -> None:
    _PROFILES[name] = profile


def apply_rules(text: Column, *names: str) -> Column:
    """Rewrites by the named rules, in the order given."""
    for name in names:
        text = F.regexp_replace(text, *_RULES[name])
    return text


def reason(text: Column, profile: str) -> Column:
    return T.quality_reason(text, _PROFILES[profile])


def identity() -> str:
    """A hash of all rules and profiles: two runs with the same one clean alike."""
    rows = [f"{k}={v}" for k, v in sorted(_RULES.items())] + [f"{k}={asdict(v)}" for k, v in sorted(_PROFILES.items())]
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def bucket_samples(df: DataFrame, buckets: list[tuple[str, Column]], cap: int, order: str) -> DataFrame:
    """(order, bucket): each row goes to the first bucket whose rule it meets and that is not full yet.

    A bucket takes the first `cap` rows of those that earlier buckets left: a top-k for each bucket
    instead of a scan in order."""
    left, out = df, None
    for name, rule in buckets:
        taken = left.where(rule).orderBy(order).limit(cap).select(order, F.lit(name).alias("bucket"))
        out = taken if out is None else out.unionByName(taken)
        left = left.join(taken.select(order), order, "left_anti")
    return out


for _name, _pattern in T.PII:
    register_rule(f"mask_{_name.lower()}", _pattern, f"<{_name}>")
register_rule("ghosts", T.GHOST, " ")
register_rule("ghosts_prose", T.GHOST_PROSE, " ")
for _name, _profile in (("script_aware", T.SCRIPT_AWARE), ("latin", T.LATIN), ("english", T.ENGLISH)):
    register_quality_profile(_name, _profile)
