"""Checksums as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn(c: Column) -> Column:
    """12 to 19 digits with a valid Luhn checksum; false for null."""
    d = digits(c)
    return F.coalesce(F.length(d).between(12, 19) & F.call_function("luhn_check", d), F.lit(False))


def aba(c: Column) -> Column:
    """Nine digits whose sum weighted 3, 7, 1 is a multiple of ten, not all zero; false for null."""
    d = digits(c)
    n = F.transform(F.split(d, ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    total = F.aggregate(F.transform(n, lambda x, i: x * F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1)), (i % 3 + 1).cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.coalesce((F.length(d) == 9) & (total > 0) & (total % 10 == 0), F.lit(False))


def iban(c: Column) -> Column:
    """15 to 34 characters, two letters and two digits first, and the rearranged number is 1 modulo 97; false for null."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, ch: F.when(ch.rlike("^[0-9]$"), (a * 10 + ch.try_cast("int")) % 97).when(ch.rlike("^[A-Z]$"), (a * 100 + (F.ascii(ch) - 55)) % 97).otherwise(a))
    return F.coalesce(F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1), F.lit(False))


#: Validators by name, as pattern specifications name them; None is always true.
REGISTRY = {"luhn": luhn, "aba": aba, "iban": iban, None: lambda c: F.lit(True)}


def validator(name: str | None):
    if name not in REGISTRY:
        raise ValueError(f"unknown validator {name!r}; known: {sorted(k for k in REGISTRY if k)}")
    return REGISTRY[name]
