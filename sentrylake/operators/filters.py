"""Predicates and state ladders over DataFrames: equality and range filters, searches, relevance, source states."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed vocabulary of item types.
ITEM_TYPES = ("vulnerability", "advisory", "news", "report", "official_alert", "guide")
ARTICLE_TYPES = ITEM_TYPES[1:]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(value: datetime | date | str) -> Column:
    """A timestamp without time zone, as the event tables have them."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.expr(f"timestamp_ntz'{text}'")


def active(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) == "active")


def of_type(df: DataFrame, item_type: str | None) -> DataFrame:
    """Items of one type; vulnerabilities where the type is blank."""
    return df.where(F.col("item_type") == ((item_type or "").strip() or "vulnerability"))


def articles(df: DataFrame) -> DataFrame:
    return df.where(F.col("item_type").isin(*ARTICLE_TYPES))


def in_year(c: str | Column, year: int) -> Column:
    """A half-open range, which Parquet statistics can use; year(c) = n could not be pushed down."""
    return (col(c) >= instant(f"{year}-01-01 00:00:00")) & (col(c) < instant(f"{year + 1}-01-01 00:00:00"))


def between_days(c: str | Column, first: date | None = None, last: date | None = None) -> Column:
    """Days first to last, both inclusive; nulls drop out where either is given."""
    found = F.lit(True)
    if first is not None:
        found = found & (col(c) >= instant(f"{first} 00:00:00"))
    if last is not None:
        found = found & (col(c) < instant(f"{last} 00:00:00") + F.expr("interval 1 day"))
    return found


def span_allowed(first: str | Column, last: str | Column, years: int = 5) -> Column:
    """Whether day `last` is within so many calendar years of day `first`; February 29 counts as 28 in a common year."""
    a, z = F.to_date(col(first)), F.to_date(col(last))
    return (z >= a) & (z <= F.add_months(a, 12 * years))


def escape_like(text: str) -> str:
    out = text
    for c in ("\\", "%", "_"):
        out = out.replace(c, "\\" + c)
    return out


def contains_any(text: str, *columns: str | Column) -> Column:
    """Case-insensitive search for literal text in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.ilike(col(c), F.lit(f"%{escape_like(text)}%"), F.lit("\\")), F.lit(False))
    return found


def matching_or_related(df: DataFrame, text: str, columns: list[str], key: str, related: DataFrame, related_key: str, related_value: str) -> DataFrame:
    """Rows where a column, or a value of a related row, contains the text; each row once.

    Related keys are reduced to distinct hits first, so the join adds a flag and never rows."""
    hits = related.where(contains_any(text, related_value)).select(F.col(related_key).alias("_hit")).distinct()
    return df.join(hits, df[key] == hits["_hit"], "left").where(contains_any(text, *columns) | F.col("_hit").isNotNull()).drop("_hit")


def three_state(df: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    return df if wanted is None else df.where(F.col(column) == F.lit(wanted))


def relevance(kind: str, status: str = "relevance", scope: str = "scope") -> Column:
    s = F.col(status)
    return {
        "direct": s == "confirmed",
        "potential": s.isin("probable", "possible"),
        "global": (s == "not_relevant") & (F.col(scope) == "global"),
        "no_evidence": s == "unknown",
    }[kind]


def relevance_label(status: str = "relevance", scope: str = "scope") -> Column:
    return (
        F.when(relevance("direct", status, scope), "Direct evidence")
        .when(relevance("potential", status, scope), "Potential relevance")
        .when(relevance("global", status, scope), "Global relevance")
        .otherwise("No demonstrated relevance")
    )


def starts_with_any(c: str, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.col(c).startswith(p)
    return found


def history(df: DataFrame, c: str, start: datetime, end: datetime, most_days: int, **equal) -> DataFrame:
    """start <= c < end and the given equalities; a span of more than most_days is an error."""
    if end <= start or (end - start).total_seconds() > most_days * 86400:
        raise ValueError(f"a span of 0 to {most_days} days is needed")
    out = df.where((F.col(c) >= instant(start)) & (F.col(c) < instant(end)))
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def by_public_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def search_text(value: str | Column, most: int = 120) -> Column:
    """Trimmed search text; null where it is blank or not allowed, see `search_state`."""
    text = F.regexp_replace(col(value), r"(?U)^\s+|\s+$", "")
    return F.when(search_state(value, most) == "given", text)


def search_state(value: str | Column, most: int = 120) -> Column:
    """'none' of blank search text; 'rejected' of over-long, unprintable or angle-bracketed text; else 'given'."""
    text = F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(text == "", "none").when((F.length(text) > most) | text.rlike(r"[<>\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"), "rejected").otherwise("given")


def slug_parameter(value: str | Column, most: int = 160) -> Column:
    """A slug in lower case; null where it is none."""
    x = F.lower(F.trim(col(value)))
    return F.when(x.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(x) <= most), x)


def choice(value: str | Column, allowed: tuple[str, ...] | list[str]) -> Column:
    """One of the allowed words, in lower case; null where it is none of them."""
    x = F.lower(F.trim(col(value)))
    return F.when(x.isin(*allowed), x)


def combination_allowed(item_type: str | Column, *vulnerability_filters: str | Column) -> Column:
    """Whether no filter of vulnerabilities comes with another type; no type is that of vulnerabilities."""
    none = F.lit(True)
    for c in vulnerability_filters:
        none = none & col(c).isNull()
    return (F.coalesce(F.nullif(F.trim(col(item_type)), F.lit("")), F.lit("vulnerability")) == "vulnerability") | none


def policy_state(implemented: str, enabled: str, needs_credentials: str, has_credentials: str) -> Column:
    return (
        F.when(~F.col(implemented), "not_implemented")
        .when(~F.col(enabled), "policy_disabled")
        .when(F.col(needs_credentials) & ~F.col(has_credentials), "credentials_required")
        .otherwise("implemented_enabled")
    )


def effective_state(now: Column, implemented="implemented", enabled="enabled", operator="operator_state", needs="needs_credentials", has="has_credentials", rate="rate_state", until="backoff_until", running="running") -> Column:
    """The first of ten states that applies, in a fixed order of precedence."""
    policy = policy_state(implemented, enabled, needs, has)
    limited = F.col(rate).isin("limited", "backoff") & (F.col(until).isNull() | (F.col(until) > now))
    return (
        F.when(policy.isin("not_implemented", "policy_disabled"), policy)
        .when(F.col(operator).isin("disabled", "paused"), F.col(operator))
        .when(policy == "credentials_required", policy)
        .when(F.col(rate) == "quota_unavailable", "quota_unavailable")
        .when(limited, "rate_limited")
        .when(F.col(running), "active")
        .otherwise("eligible")
    )


def freshness(now: Column, last: str, usable: Column, hours: int = 4) -> Column:
    return (
        F.when(~usable, "not_applicable")
        .when(F.col(last).isNull(), "never")
        .when(now - F.col(last) <= F.expr(f"interval {hours} hours"), "fresh")
        .otherwise("stale")
    )


def available_actions(operator: str, running: str, usable: Column, can_run: Column) -> Column:
    idle = ~F.col(running)
    on, paused, off = (F.col(operator) == s for s in ("enabled", "paused", "disabled"))
    return F.array_compact(
        F.array(
            F.when(idle & on, "pause"),
            F.when(idle & paused, "resume"),
            F.when(idle & (on | paused), "disable"),
            F.when(idle & off & usable, "enable"),
            F.when(idle & on & usable & can_run, "manual_run"),
        )
    )


def derived_page(df: DataFrame, state: Column, wanted: str, order: list, offset: int, limit: int) -> DataFrame:
    """A page of the rows whose derived state is the wanted one."""
    return df.withColumn("effective_state", state).where(F.col("effective_state") == wanted).orderBy(*order).offset(offset).limit(limit)
