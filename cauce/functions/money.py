"""Money and rate expressions: display formats, French amortisation, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cauce import fixed


def cop_display(amount: Column) -> Column:
    """``$5.600.000``: round to the nearest thousand half-even, dot thousands."""
    rounded = (F.bround(amount / 1000.0, 0) * 1000).cast("bigint")
    return F.concat(F.lit("$"), F.replace(F.format_number(rounded, 0), F.lit(","), F.lit(".")))


def rate_display(rate: Column) -> Column:
    """``14,5% E.A.`` from 0.145."""
    return F.concat(F.replace(F.format_string("%.1f", rate * 100), F.lit("."), F.lit(",")), F.lit("% E.A."))


def parse_cop_display(text: Column) -> Column:
    """``$5.600.000`` -> 5600000.00; malformed text -> null (never an error)."""
    return F.regexp_replace(text, r"[$.]", "").try_cast("decimal(18,2)")


def parse_rate_display(text: Column) -> Column:
    """``14,5% E.A.`` -> 14.5; malformed text -> null."""
    cleaned = F.replace(F.replace(F.replace(text, F.lit("% E.A."), F.lit("")), F.lit(","), F.lit(".")), F.lit("%"), F.lit(""))
    return F.trim(cleaned).try_cast("decimal(6,3)")


def monthly_rate(annual_rate: Column) -> Column:
    """Effective monthly rate i = (1 + r)^(1/12) - 1."""
    return F.pow(F.lit(1.0) + annual_rate, F.lit(1.0 / 12)) - 1


def instalment(amount: Column, annual_rate: Column, term_months: Column) -> Column:
    """French amortisation instalment A*i / (1 - (1+i)^-n)."""
    i = monthly_rate(annual_rate)
    return amount * i / (F.lit(1.0) - F.pow(F.lit(1.0) + i, -term_months))


def amount_for_instalment(max_instalment: Column, annual_rate: Column, term_months: Column) -> Column:
    """Inverse of the French formula: the amount a given instalment repays."""
    i = monthly_rate(annual_rate)
    return max_instalment * (F.lit(1.0) - F.pow(F.lit(1.0) + i, -term_months)) / i


def income_in_wages(income: Column) -> Column:
    """Income in legal minimum wages, kept within 1 and 25; null and NaN give null."""
    known = F.when(~F.isnan(income.cast("double")), income.cast("double"))
    return F.when(known.isNotNull(), F.least(F.greatest(known / fixed.SMMLV_COP, F.lit(1.0)), F.lit(25.0)))


def wage_tier(income: Column) -> Column:
    """A up to 2 minimum wages, B up to 4, C above; null without an income."""
    wages = income_in_wages(income)
    return F.when(wages <= 2, "A").when(wages <= 4, "B").when(wages > 4, "C")
