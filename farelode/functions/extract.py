"""Classifiers and extractors of policy clauses, as column expressions.

Each is an ordered chain of conditions: the first that holds decides. Classifiers look at the lower-case, squeezed text;
the patterns for amounts, percentages and snippets look at the text as it stands. ``low`` is that lower-case text where it
stands in a column already, so that it is computed once for all classifiers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from farelode.functions.text import LEFT, RIGHT, SPACE, bare_clause, distinct_ignoring_case, lowered

# ---------------------------------------------------------------------------------------------------------------------
# Phrases and patterns in the order in which they are tried.
NOT_ALLOWED = ("not permitted", "not allowed", "no refund", "no refunds", "non-refundable", "non refundable", "cannot", "prohibited", "forfeit", "forfeiture")
CONDITIONAL = ("subject to", "provided that", "if ", "when ", "unless ", "before departure", "after departure", "with fee", "fee applies", "penalty applies")
ALLOWED = ("allowed", "permitted", "can be changed", "can be refunded", "may be changed", "may be refunded", "refundable", "changeable")
TIME_WINDOWS = ("before departure", "after departure", "prior to departure", "within 24 hours", "within 24 hrs", "after no-show", "before no-show")
CONDITION_OPENERS = ("subject to", "provided that", "only if", "if", "when")
EXCEPTION_OPENERS = ("except(?: for)?", "excluding", "does not apply to", "not applicable to", "unless")
CONDITION_CUTS = (
    " without fee", " with usd ", " with eur ", " with gbp ", " with aed ", " with sar ", " with inr ", " with pkr ", " with cad ", " with aud ",
    " with fare difference", " and taxes only refundable", " with 20% penalty", " with penalty",
)
NO_SHOW, GO_SHOW, WAIVER = ("no-show", "no show"), ("go-show", "go show"), ("waiver", "waive")
CHANGE = "(?:reissue|re-?book|changes?)"
BEFORE_DEPARTURE, AFTER_DEPARTURE = ("before departure", "prior to departure"), ("after departure", "after no-show")
FREE = ("no fee", "without fee", "free of charge")
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
NEAR = r"[^.:\n]{0,40}"
CURRENCIES = "USD|EUR|GBP|AED|SAR|INR|PKR|BDT|CAD|AUD"
ONLY_TAXES = ("only taxes", "taxes only", "tax only", "only tax")
NON_REFUNDABLE = "(?:non[- ]refundable|not refundable)"
STUB_NOTE = "Stub extractor output; classify topic/action and parse structured penalties in next iteration."
# ---------------------------------------------------------------------------------------------------------------------


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def policy_topic(text: Column, low: Column | None = None) -> Column:
    t = lowered(text) if low is None else low
    return (
        F.when(any_of(t, NO_SHOW), "no_show")
        .when(any_of(t, GO_SHOW), "go_show")
        .when(t.rlike(rf"{LEFT}{CHANGE}{RIGHT}"), "reissue_change")
        .when(t.contains("refund"), "refund")
        .when(t.contains("cancel"), "cancellation")
        .when(any_of(t, WAIVER), "waiver")
        .otherwise("other")
    )


def policy_action(text: Column, low: Column | None = None) -> Column:
    """Denials first; then permissions, conditional where a condition or a fee stands beside; then conditions alone."""
    t = lowered(text) if low is None else low
    condition = any_of(t, CONDITIONAL) | t.rlike(rf"{LEFT}fee{RIGHT}")
    return F.when(any_of(t, NOT_ALLOWED), "not_allowed").when(any_of(t, ALLOWED), F.when(condition, "conditional").otherwise("allowed")).when(condition, "conditional").otherwise("unknown")


def time_window(text: Column, low: Column | None = None) -> Column:
    """The first phrase of the list, in the list's order, that the text has."""
    t = lowered(text) if low is None else low
    return F.coalesce(*[F.when(t.contains(p), p) for p in TIME_WINDOWS])


def departure_side(text: Column, low: Column | None = None) -> Column:
    t = lowered(text) if low is None else low
    before, after = any_of(t, BEFORE_DEPARTURE), any_of(t, AFTER_DEPARTURE)
    return F.when(before & after, "both").when(before, "before_departure").when(after, "after_departure")


def _snippets(text: Column, openers: tuple[str, ...]) -> Column:
    """All stretches from an opener to the next period, semicolon or line break, by opener, then by position."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i){LEFT}{o}{RIGHT}[^.;\n]+"), 0) for o in openers]
    return F.flatten(F.array(*found))


def _cut_condition(snippet: Column) -> Column:
    bare = bare_clause(snippet)
    low = F.lower(bare)
    first = F.least(*[F.nullif(F.instr(low, m), F.lit(0)) for m in CONDITION_CUTS])
    return F.when(first.isNull(), bare).otherwise(F.rtrim(F.substring(bare, F.lit(1), first - 1)))


def _unique_clauses(items: Column) -> Column:
    return distinct_ignoring_case(F.filter(F.transform(items, bare_clause), lambda x: x != ""))


def eligibility_conditions(text: Column) -> Column:
    return _unique_clauses(F.transform(_snippets(text, CONDITION_OPENERS), _cut_condition))


def exceptions(text: Column) -> Column:
    return _unique_clauses(_snippets(text, EXCEPTION_OPENERS))


def tax_refund_rule(text: Column, low: Column | None = None) -> Column:
    t = lowered(text) if low is None else low
    return F.when(
        t.contains("tax"),
        F.when(any_of(t, ONLY_TAXES) & t.contains("refund"), "only taxes refundable")
        .when(t.rlike(f"tax(?:es)?{NEAR}{NON_REFUNDABLE}") | t.rlike(f"{NON_REFUNDABLE}{NEAR}tax(?:es)?"), "taxes non-refundable")
        .when(t.rlike(f"tax(?:es)?{NEAR}refundable") | t.contains("refundable taxes"), "taxes refundable"),
    )


PENALTY_TYPE = "struct<penalty_type:string,penalty_amount:double,penalty_currency:string,penalty_percent:double,fare_difference_required:boolean>"


def penalty(text: Column, low: Column | None = None) -> Column:
    """The penalty as one struct; the first branch that holds fills its fields, the others stay null.

    Of several amounts the leftmost counts, whether written with a currency code or with a dollar sign.
    """
    t, raw = lowered(text) if low is None else low, F.coalesce(text, F.lit(""))
    amount = rf"(?i){LEFT}({CURRENCIES}){SPACE}*({NUMBER}){RIGHT}|\$({NUMBER})"
    percent = F.nullif(F.regexp_extract(raw, rf"(\d+(?:\.\d+)?){SPACE}*%", 1), F.lit(""))
    code, coded, dollars = (F.nullif(F.regexp_extract(raw, amount, i), F.lit("")) for i in (1, 2, 3))

    def of(kind: str | None = None, value: Column | None = None, currency: Column | None = None, share: Column | None = None, difference: bool | None = None) -> Column:
        parts = [F.lit(kind), value if value is not None else F.lit(None), currency if currency is not None else F.lit(None), share if share is not None else F.lit(None), F.lit(difference)]
        names = ("penalty_type", "penalty_amount", "penalty_currency", "penalty_percent", "fare_difference_required")
        return F.struct(*[p.alias(n) for p, n in zip(parts, names)]).cast(PENALTY_TYPE)

    return (
        F.when(t.contains("forfeit"), of("forfeiture"))
        .when(any_of(t, FREE), of("free"))
        .when(t.contains("fare difference only"), of("fare_difference_only", difference=True))
        .when(percent.isNotNull(), of("percentage", share=percent.try_cast("double")))
        .when(code.isNotNull(), of("fixed_amount", coded.try_cast("double"), F.upper(code)))
        .when(dollars.isNotNull(), of("fixed_amount", dollars.try_cast("double"), F.lit("USD")))
        .when(t.contains("fare difference"), of(difference=True))
        .otherwise(of())
    )

