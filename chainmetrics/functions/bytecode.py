"""Contract bytecode as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte pattern of minimal proxies around the implementation address.
MINIMAL_PREFIX = "363d3d373d3d3d363d73"
MINIMAL_SUFFIX = "5af43d82803e903d91602b57fd5bf3"
#: One opcode with its operand: PUSH1 to PUSH32 (60 to 7f) take 1 to 32 bytes; a push cut off by the end takes the rest.
INSTRUCTION = "(" + "|".join([f"{0x60 + n:02x}[0-9a-f]{{{2 * n + 2}}}" for n in range(32)] + ["[67][0-9a-f].*$", "[0-58-9a-f][0-9a-f]"]) + ")"
INSTRUCTIONS_READ = 500


def clean(code: Column) -> Column:
    """Hex digits in lower case without 0x; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(code), "^0x", ""), F.lit(""))


def fingerprint(code: Column) -> Column:
    """SHA-256 of the bytecode as it stands; null stays null."""
    return F.sha2(code, 256)


def minimal_proxy_target(code: Column) -> Column:
    """Implementation address of a minimal proxy; null for other code."""
    own = clean(code)
    fits = own.startswith(MINIMAL_PREFIX) & own.endswith(MINIMAL_SUFFIX) & (F.length(own) >= 90)
    return F.when(fits, F.concat(F.lit("0x"), F.substring(own, 21, 40)))


def selectors(code: Column) -> Column:
    """Sorted distinct operands (0x and 8 digits) of PUSH4 among the first 500 instructions; empty without code."""
    steps = F.slice(F.regexp_extract_all(clean(code), F.lit(INSTRUCTION), F.lit(1)), 1, INSTRUCTIONS_READ)
    pushed = F.filter(steps, lambda s: s.startswith("63") & (F.length(s) == 10))
    found = F.sort_array(F.array_distinct(F.transform(pushed, lambda s: F.concat(F.lit("0x"), F.substring(s, 3, 8)))))
    return F.coalesce(found, F.array().cast("array<string>"))


def has_all(have: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(have, F.array(*map(F.lit, wanted)))) == len(wanted)


def has_any(have: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(have, F.array(*map(F.lit, wanted)))
