"""Small column functions of records: names, dates, keys, buckets, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def document_id(path: Column, suffix: Column) -> Column:
    """File name and suffix, with anything but letters, digits, dots and hyphens as underscores."""
    return F.regexp_replace(F.concat_ws("_", base_name(path), suffix), r"[^\w\-.]", "_")


def report_date(name: Column) -> Column:
    """Time in a name with ``YYYYMMDD_HHMMSS``, null without a valid one."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


def duration(started: Column, completed: Column) -> Column:
    """Seconds between two ISO texts; null if one is not a time."""
    return (F.unix_micros(F.try_to_timestamp(completed)) - F.unix_micros(F.try_to_timestamp(started))) / 1e6


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def quality_level(score: Column) -> Column:
    return F.when(score >= 9, "excellent").when(score >= 7, "good").when(score >= 4, "fair").otherwise("poor")


def prompt_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *parts))


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def entity_value(entity: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(entity, F.lit(name)), F.lit(default))


def result_matches(result: Column, expected: Column, exact: Column) -> Column:
    """Equal if exact, else contained whatever the case."""
    return F.when(exact, result == expected).otherwise(F.lower(result).contains(F.lower(expected)))


def first_condition(code: Column) -> Column:
    """What stands in the parentheses of the first ``if``."""
    return or_null(F.regexp_extract(code, r"\bif\s*\(([^)]*)\)", 1))


def risk_factors(code: Column, payable: Column, transfers: Column) -> Column:
    """Array of what makes a function risky."""
    return F.array_compact(F.array(
        F.when(payable, "Accepts Ether"), F.when(code.contains("selfdestruct"), "Contains selfdestruct"), F.when(code.contains("delegatecall"), "Uses delegatecall"),
        F.when(code.contains("assembly"), "Contains assembly code"), F.when(transfers, "Transfers value"),
    ))


def risk_level(factors: Column) -> Column:
    """high, medium or low by the worst factor; none without one."""
    high, medium = (F.array(*map(F.lit, x)) for x in (("Contains selfdestruct", "Uses delegatecall"), ("Accepts Ether", "Transfers value")))
    return F.when(F.arrays_overlap(factors, high), "high").when(F.arrays_overlap(factors, medium), "medium").when(F.size(factors) > 0, "low").otherwise("none")


def flow_severity(surfaces: Column, confidence: Column) -> Column:
    sure = F.coalesce(confidence, F.lit(0.5)) > 0.7
    return F.when((surfaces > 5) | ((surfaces > 2) & sure), "high").when((surfaces > 2) | ((surfaces > 0) & sure), "medium").otherwise("low")


def documentation_language(text: Column) -> Column:
    """Language of a documented file by what only it has."""
    return (
        F.when(text.rlike(r"pragma solidity|\bcontract\s+\w+"), "solidity").when(text.rlike(r"(?m)^\s*(def|class)\s+\w+.*:"), "python")
        .when(text.rlike(r"\bfunction\b|=>|\bconst\b"), "javascript").when(text.rlike(r"(?m)^#{1,6} "), "markdown").otherwise("unknown")
    )


def middle_cut(text: Column, limit: int = 4000, head: int = 3000, tail: int = 1000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)
