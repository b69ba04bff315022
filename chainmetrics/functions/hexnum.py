"""Hexadecimal text, 256-bit numbers and ABI words as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_ADDRESS = "0x" + "0" * 40
#: Wide numbers are read in parts of 14 hex digits (56 bits) and written in limbs of 18 decimal digits.
PART, BITS, LIMB, LIMBS = 14, 56, 10**18, 5
WIDTH = LIMBS * PART


def strip_0x(text: Column) -> Column:
    return F.when(F.lower(F.left(text, F.lit(2))) == "0x", F.substring(text, 3, 1 << 30)).otherwise(text)


def hex_to_dec(text: Column) -> Column:
    """Long of a hex text of at most 63 bits; null if null, empty, malformed or longer."""
    digits = strip_0x(text)
    return F.when(digits.rlike("^(?=.)0*+(?:[1-7][0-9a-fA-F]{15}|[0-9a-fA-F]{0,15})$"), F.conv(F.right(digits, F.lit(16)), 16, 10).cast("long"))


def normalized_address(text: Column) -> Column:
    """Lower case; null stays null."""
    return F.lower(text)


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once, however often body names it; its code does not grow with each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def u256_decimal(text: Column) -> Column:
    """Decimal text of a hex text of at most 256 bits; null if null, empty, malformed or longer.

    What fits 60 bits is one conversion, what fits 112 bits two halves in decimal arithmetic. Only longer numbers are
    folded limb by limb.
    """
    return _named(strip_0x(text), lambda d: F.when(d.rlike("^[0-9a-fA-F]{1,64}$"), _named(F.lpad(d, WIDTH, "0"), _padded_decimal)))


def _padded_decimal(padded: Column) -> Column:
    part = lambda start, digits: F.conv(F.substring(padded, start + 1, digits), 16, 10)
    halves = part(WIDTH - 2 * PART, PART).cast("decimal(17,0)") * F.lit(2**BITS).cast("decimal(17,0)") + part(WIDTH - PART, PART).cast("decimal(17,0)")
    return F.when(F.startswith(padded, F.lit("0" * (WIDTH - 15))), part(WIDTH - 15, 15)).when(F.startswith(padded, F.lit("0" * (WIDTH - 2 * PART))), halves.cast("string")).otherwise(_long_decimal(padded))


def _long_decimal(padded: Column) -> Column:
    """Decimal text of WIDTH hex digits, by limbs of 18 decimal digits from the low end."""
    parts = F.array(*(F.conv(F.substring(padded, i * PART + 1, PART), 16, 10).cast("decimal(20,0)") for i in range(LIMBS)))
    limbs = F.aggregate(parts, F.array_repeat(F.lit(0).cast("decimal(20,0)"), LIMBS), _fold)
    return F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 18, "0")), ""), "^0+(?=.)", "")


def _div(a: Column, b: int) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def _fold(limbs: Column, part: Column) -> Column:
    """limbs * 2^56 + part, limbs from the low end."""
    start = F.struct(part.alias("carry"), F.array().cast("array<decimal(20,0)>").alias("done"))
    limb = F.lit(LIMB).cast("decimal(19,0)")

    def one(acc: Column, x: Column) -> Column:
        total = x * F.lit(2**BITS).cast("decimal(17,0)") + acc["carry"]
        return F.struct(F.call_function("div", total, limb).cast("decimal(20,0)").alias("carry"), F.concat(acc["done"], F.array((total % limb).cast("decimal(20,0)"))).alias("done"))

    return F.aggregate(limbs, start, one, lambda acc: acc["done"])


def to_double(text: Column) -> Column:
    """Lenient float: null when it cannot be read."""
    return text.try_cast("double")


def words(data: Column) -> Column:
    """The 32-byte words of log data, as 64 hex digits each; a last part that is not full is kept as it is."""
    return chunks(strip_0x(F.coalesce(data, F.lit(""))), 64)


def chunks(text: Column, size: int) -> Column:
    """text in parts of size characters."""
    parts = lambda t: F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / size).cast("int") - 1), lambda i: F.substring(t, i * size + 1, F.lit(size)))
    return _named(text, lambda t: F.when(F.length(t) > 0, parts(t)).otherwise(F.when(t.isNotNull(), F.array().cast("array<string>"))))


def topic_address(topic: Column) -> Column:
    """Address in the last 20 bytes of a topic."""
    return F.when(topic.isNotNull(), F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40)))))


def word_address(word: Column) -> Column:
    """Address in a storage word; null when empty, short or zero."""
    address = topic_address(word)
    return F.when((F.length(word) >= 42) & (address != ZERO_ADDRESS), address)


def _array_at(parts: Column, slot: int) -> Column:
    """The uint256[] whose offset stands in word `slot`; null if offset or length lead outside the data."""
    offset = hex_to_dec(F.get(parts, F.lit(slot)))
    head = _div(offset, 32)
    count = hex_to_dec(F.when((offset % 32 == 0) & (head < F.size(parts)), F.get(parts, head.cast("int"))))
    fits = (head + 1 + count) <= F.size(parts)
    inside = F.slice(parts, (head + 2).cast("int"), F.greatest(count, F.lit(0)).cast("int"))
    whole = F.forall(inside, lambda w: F.length(w) == 64)
    return F.when(fits & whole, F.transform(inside, u256_decimal))


def two_uint_arrays(data: Column) -> Column:
    """(ids, values) of ABI data (uint256[], uint256[]); null if malformed."""
    parts = words(data)
    ids, values = _array_at(parts, 0), _array_at(parts, 1)
    return F.when(ids.isNotNull() & values.isNotNull(), F.struct(ids.alias("ids"), values.alias("values")))


def abi_text(data: Column) -> Column:
    """Text of a call result: an ABI string (offset 0x20, length, bytes), else a bytes32, else all bytes; nulls trimmed."""
    digits = strip_0x(data)
    length = hex_to_dec(F.substring(digits, 65, 64))
    dynamic = (hex_to_dec(F.substring(digits, 1, 64)) == 32) & (length * 2 + 128 <= F.length(digits))
    body = F.when(F.coalesce(dynamic, F.lit(False)), F.substr(digits, F.lit(129), (length * 2).cast("int"))).when(F.length(digits) == 64, F.regexp_replace(digits, "(00)+$", "")).otherwise(digits)
    clean = F.regexp_replace(F.decode(F.try_to_binary(body, F.lit("hex")), "UTF-8"), "^\u0000+|\u0000+$", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) % 2 == 0) & digits.rlike("^[0-9a-fA-F]*$"), F.nullif(clean, F.lit("")))


def signed_double(word: Column) -> Column:
    """Double of a two's-complement 256-bit word."""
    digits = strip_0x(word)
    negative = F.substring(digits, 1, 1).rlike("[89a-fA-F]")
    flipped = F.translate(F.lower(digits), "0123456789abcdef", "fedcba9876543210")
    return F.when(negative, -(u256_decimal(flipped).cast("double") + 1)).otherwise(u256_decimal(digits).cast("double"))


def round_data(result: Column, decimals: Column) -> Column:
    """price and updated_at of a latestRoundData result (five words); decimals default to 18; null if malformed."""
    parts = words(result)
    scale = F.pow(F.lit(10.0), F.coalesce(decimals, F.lit(18)).cast("double"))
    full = (F.size(parts) >= 5) & reduce(lambda a, b: a & b, [F.length(F.get(parts, F.lit(i))) == 64 for i in range(5)])
    return F.when(full, F.struct((signed_double(F.get(parts, F.lit(1))) / scale).alias("price"), hex_to_dec(F.get(parts, F.lit(3))).alias("updated_at")))
