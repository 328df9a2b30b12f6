"""Walks over pages that a collector has dropped as files: whether they are whole, and where they stopped.

A walk is what one request series gave: a window of changes, a collection, a query. It has a bounded number of pages
(the request limits of its source), so its pages may meet in one row; walks are independent of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pages(pages: DataFrame, walk: list[str], place: str, *fields: str) -> DataFrame:
    return pages.groupBy(*walk).agg(F.array_sort(F.collect_list(F.struct(place, *fields))).alias("_p"))


def _first(problems: list[tuple[str, Column]]) -> Column:
    """The problem of the earliest page, and where: struct(at, outcome); null if there is none."""
    return F.array_min(F.array_compact(F.array(*(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(i).alias("rank"), F.lit(name).alias("outcome"))) for i, (name, at) in enumerate(problems)))))


def _where(test) -> Column:
    """The first index at which test(page, index) holds; null if there is none."""
    hits = F.filter(F.transform("_p", lambda p, i: F.when(test(p, i), i)), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, F.array_min(hits))


def _before(i: Column, field: str) -> Column:
    return F.get("_p", i - 1).getField(field)


def indexed_walks(pages: DataFrame, walk: list[str], place: str, start: str, total: str, n: str, most_pages: int) -> DataFrame:
    """(walk, pages, records, outcome) of pages by start index: complete; else the first of mismatch (a page does not start
    where the one before it ended), total_changed, no_progress (an empty page before the end), page_limit (more than
    `most_pages`), or incomplete (the last page is not the end)."""
    p = _pages(pages, walk, place, start, total, n)
    problems = [
        ("mismatch", _where(lambda x, i: x[start] != F.coalesce(_before(i, start) + _before(i, n), F.lit(0)))),
        ("total_changed", _where(lambda x, i: x[total] != F.coalesce(_before(i, total), x[total]))),
        ("no_progress", _where(lambda x, i: (x[n] == 0) & (x[start] < x[total]))),
        ("page_limit", _where(lambda x, i: i >= most_pages)),
        ("incomplete", _where(lambda x, i: (i == F.size("_p") - 1) & (x[start] + x[n] < x[total]))),
    ]
    records = F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x[n])
    return p.select(*walk, F.size("_p").alias("pages"), records.alias("records"), F.coalesce(_first(problems).getField("outcome"), F.lit("complete")).alias("outcome"))


def token_walks(pages: DataFrame, walk: list[str], place: str, token: str, following: str, more: str, most_pages: int) -> DataFrame:
    """(walk, pages, outcome) of pages by token: complete; else the first of mismatch (a page was not asked for by the token
    of the one before it), repeated_token (a page names a token that was asked for before), no_progress (more is to come
    without a token), trailing (a page after the end), page_limit, or incomplete (the last page says that more is to come)."""
    p = _pages(pages, walk, place, token, following, more)
    asked = lambda i: F.transform(F.slice("_p", 1, i + 1), lambda y: y[token])
    problems = [
        ("mismatch", _where(lambda x, i: ~x[token].eqNullSafe(_before(i, following)))),
        ("repeated_token", _where(lambda x, i: F.coalesce(F.array_contains(F.array_compact(asked(i)), x[following]), F.lit(False)))),
        ("no_progress", _where(lambda x, i: x[more] & x[following].isNull())),
        ("trailing", _where(lambda x, i: ~F.coalesce(_before(i, more), F.lit(True)))),
        ("page_limit", _where(lambda x, i: i >= most_pages)),
        ("incomplete", _where(lambda x, i: (i == F.size("_p") - 1) & x[more])),
    ]
    return p.select(*walk, F.size("_p").alias("pages"), F.coalesce(_first(problems).getField("outcome"), F.lit("complete")).alias("outcome"))


def candidate_queries(severities: tuple[str, ...] = ("critical", "high", "medium", "low")) -> list[tuple[int, str, str | None]]:
    """(place, field, value) of the nine queries for each chunk of a year: known exploited first, then each severity by the
    newer and the older score."""
    by_severity = [(field, s) for s in severities for field in ("v4_severity", "v3_severity")]
    return [(i, f, v) for i, (f, v) in enumerate([("listed", None), *by_severity])]


def collected_candidates(records: DataFrame, chunk_days: int, page_rows: int, most_pages: int, most_requests: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and requests of records(id, published, listed, v3_severity, v4_severity), year by year, each in chunks of
    days and for each chunk by the nine queries in turn.

    The first is (id, year, place, queries): each record once, at the request that first gave it, and how many gave it. The second is
    (year, requests, reason): a query gives at most `most_pages` pages ('page_limit' where there were more), and all years
    together `most_requests` requests ('request_limit' from the year on in which they are used up); else 'complete'.
    Requests are counted for each chunk and query first, and these counts, a few hundred a year, are what is numbered."""
    r = records.withColumn("year", F.year("published")).withColumn("chunk", F.floor((F.dayofyear("published") - 1) / chunk_days))
    hits = F.array(*(F.when(F.col("listed") if f == "listed" else F.col(f) == v, F.lit(i)) for i, f, v in candidate_queries()))
    met = r.select("id", "year", "chunk", "published", F.explode(F.array_compact(hits)).alias("place"))
    # pages are in order of publication, ties by id
    sizes = met.groupBy("year", "chunk", "place").agg(F.count(F.lit(1)).alias("n"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = r.select("year").distinct().select("year", each(-(-366 // chunk_days)).alias("chunk")).select("year", F.col("chunk").cast("long").alias("chunk"), each(len(candidate_queries())).alias("place"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / page_rows))
    asked = grid.join(sizes, ["year", "chunk", "place"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("asked", F.least(pages, F.lit(most_pages))).withColumn("cut", pages > most_pages)
    before = Window.orderBy("year", "chunk", "place").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("before", F.coalesce(F.sum("asked").over(before), F.lit(0))).withColumn("given", F.greatest(F.lit(0), F.least(F.col("asked"), most_requests - F.col("before"))))
    at = F.row_number().over(Window.partitionBy("year", "chunk", "place").orderBy("published", "id"))
    # no query gives more than this, so that each task passes on so many rows of a query at most
    first = met.withColumn("at", at).where(F.col("at") <= most_pages * page_rows)
    ranked = first.join(asked.select("year", "chunk", "place", "given", "before"), ["year", "chunk", "place"])
    kept = ranked.where(F.col("at") <= F.col("given") * page_rows)
    candidates = kept.groupBy("id", "year").agg(F.min("before").alias("place"), F.count(F.lit(1)).alias("queries"))
    reasons = asked.groupBy("year").agg(F.sum("given").alias("requests"), F.when(F.max(F.col("given") < F.col("asked")), "request_limit").when(F.max("cut"), "page_limit").otherwise("complete").alias("reason"))
    return candidates, reasons
