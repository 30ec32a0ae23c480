"""Scalar commands over values as column expressions. Where a command answers with an error, these give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = (1 << 63) - 1


def getrange(value: Column, start: Column, end: Column) -> Column:
    """Bytes start to end, both inclusive; negative ones count from the end; both are clamped."""
    size = F.octet_length(value)
    first = F.greatest(F.when(start < 0, size + start).otherwise(start), F.lit(0))
    last = F.least(F.when(end < 0, F.greatest(size + end, F.lit(0))).otherwise(end), size - 1)
    none = (size == 0) | (first > last)
    return F.when(none, F.substring(value, 1, 0)).otherwise(F.substr(value, (first + 1).cast("int"), (last - first + 1).cast("int")))


def setrange(value: Column, offset: Column, patch: Column) -> Column:
    """The binary value, filled up with zero bytes to offset, with patch over it; an empty patch changes nothing."""
    own = F.coalesce(value, F.lit("").cast("binary"))
    size, end = F.octet_length(own), offset + F.octet_length(patch)
    head = F.rpad(own, F.greatest(size, offset).cast("int"), F.lit(b"\x00"))
    spliced = F.concat(F.substr(head, F.lit(1), offset.cast("int")), patch, F.when(size > end, F.substr(own, (end + 1).cast("int"), F.greatest(size - end, F.lit(0)).cast("int"))).otherwise(F.lit(b"")))
    return F.when(F.octet_length(patch) == 0, own).otherwise(spliced)


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def integer(value: Column) -> Column:
    """A stored integer: trimmed decimal text; 0 for a missing value, null for any other text."""
    text = F.trim(value.cast("string"))
    return F.when(value.isNull(), F.lit(0).cast("long")).when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))


def incrby(value: Column, by: Column) -> Column:
    """The sum, null for a value that is no integer and on overflow."""
    return F.try_add(integer(value), by.cast("long"))


def ttl_ms(exists: Column, deadline: Column, now: Column) -> Column:
    """-2 for a missing key, -1 without a deadline, else what is left."""
    return F.when(~exists, -2).when(deadline.isNull(), -1).otherwise(F.greatest(F.lit(0), deadline - now)).cast("long")


def ttl_seconds(exists: Column, deadline: Column, now: Column) -> Column:
    """As ttl_ms, in seconds, rounded up."""
    ms = ttl_ms(exists, deadline, now)
    return F.when(ms < 0, ms).otherwise(F.ceil(ms / 1000)).cast("long")


def deadline(form: str, amount: Column, now: Column) -> Column:
    """The absolute deadline in ms of EX, PX (from now), EXAT or PXAT; null past the largest long."""
    wide = amount.cast("decimal(38,0)")
    at = {"EX": now.cast("decimal(38,0)") + wide * 1000, "PX": now.cast("decimal(38,0)") + wide, "EXAT": wide * 1000, "PXAT": wide}[form]
    return F.when((at <= LARGEST) & (at >= -LARGEST - 1), at.cast("long"))


def expire_allowed(guard: str, current: Column, new: Column) -> Column:
    """Whether NX, XX, GT or LT lets a deadline be set; no deadline is later than any."""
    return {"": F.lit(True), "NX": current.isNull(), "XX": current.isNotNull(), "GT": F.coalesce(new > current, F.lit(False)), "LT": F.coalesce(new < current, F.lit(True))}[guard]


def set_allowed(guard: str, current: Column) -> Column:
    """Whether NX or XX lets a value be set."""
    return {"": F.lit(True), "NX": current.isNull(), "XX": current.isNotNull()}[guard]


def retry_seconds(attempts: Column) -> Column:
    """Backoff: doubling, at most a minute."""
    return F.least(F.pow(F.lit(2), F.least(attempts, F.lit(6))), F.lit(60)).cast("long")


def natural_order(name: Column) -> Column:
    """A sort key by which stage_2 comes before stage_10."""
    return F.struct(F.regexp_extract(name, r"^(.*?)[0-9]*$", 1), F.regexp_extract(name, r"([0-9]*)$", 1).try_cast("long"))
