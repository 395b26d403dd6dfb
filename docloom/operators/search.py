"""Retrieval as one operation: vectors, dates, summaries, thresholds and context for a stated set of queries.

Every branch is cut to a few rows a query inside its tasks, so what is joined, tiered
and merged afterwards grows with the queries and never with the records.

Queries: query_id, query_text, query_vector and, where searches are filtered, the column
``same``.  Records: id, vector, content, dates (joined by ``; ``), keywords (joined by
``, ``), is_summary, original_content, and ``same``.  A record belongs to a date that is
one of its dates.  Null texts ask nothing; records without a vector are found by dates
alone; ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.dates import detect_dates, partial_match
from docloom.operators.retrieval import is_date_query, keyword_relevant, without_summarised
from docloom.operators.vectors import nearest, nearest_of_key
from docloom.sources.shared import stored

FIELDS = ["content", "dates", "keywords", "is_summary", "original_content"]
#: Records that are looked through where no result has a date, exact hits on a date string, and rows of a context.
FIRST, EXACT, CONTEXT = 100, 20, 20


def asked(queries: DataFrame, same: str | None = None) -> DataFrame:
    """Queries with ``asks_date`` (a word about dates) and ``asked_dates``, stored since all branches read them."""
    word = F.coalesce(is_date_query(F.col("query_text")), F.lit(False))
    found = detect_dates(F.when(word | F.col("query_text").rlike("[0-9]"), F.col("query_text")))
    return stored(queries.select("query_id", "query_text", "query_vector", *([same] if same else []), word.alias("asks_date"), found.alias("asked_dates")), "asked")


def date_list(dates: Column) -> Column:
    return F.filter(F.split(dates, "; "), lambda d: d != "")


def fetched(q: DataFrame, records: DataFrame, n: int, same: str | None = None) -> DataFrame:
    """The n results of each query (query_id, id, distance, ord, has_date and the records' fields).

    Of the 2n nearest, or where dates are asked for of the 2n nearest with such a date, then the n nearest
    of all, originals go whose summary came before; records with a date asked for come first, then the nearest.
    """
    dated_query = F.size("asked_dates") > 0
    group = lambda c: F.concat_ws("\x00", c, F.col(same).cast("string")) if same else F.col(c)
    dates_of = lambda df, dates: df.withColumn("_date", F.explode(F.array_distinct(dates)))
    by_date = nearest_of_key(
        dates_of(q, F.col("asked_dates")).select("query_id", F.col("query_vector").alias("vector"), group("_date").alias("key")),
        dates_of(records.where("vector is not null"), date_list(F.col("dates"))).select("id", "vector", group("_date").alias("key")),
        2 * n,
    )
    if same:
        plain = nearest_of_key(q.select("query_id", F.col("query_vector").alias("vector"), F.col(same).alias("key")), records.where("vector is not null").select("id", "vector", F.col(same).alias("key")), 2 * n)
    else:
        plain = nearest(q, records, 2 * n, "id", "vector")
    plain = plain.join(q.select("query_id", dated_query.alias("_dated")), "query_id").where(~F.col("_dated") | (F.col("rank") <= n)).drop("_dated")
    both = by_date.withColumn("_branch", F.lit(0)).unionByName(plain.withColumn("_branch", F.lit(1)))
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("_branch"))).where("_n = 1")
    in_order = once.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("_branch", "rank"))).select("query_id", "id", "distance", "ord")
    told = in_order.join(records.select("id", *FIELDS), "id").withColumn("is_summary", F.coalesce("is_summary", F.lit(False)))
    told = without_summarised(told).join(q.select("query_id", "asked_dates"), "query_id")
    told = told.withColumn("has_date", F.coalesce(F.arrays_overlap(date_list(F.col("dates")), F.col("asked_dates")), F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.desc("has_date"), "distance", "ord")
    return told.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= n).select("query_id", "id", "distance", "ord", "has_date", *FIELDS)


def first_dated(records: DataFrame, first: int = FIRST) -> DataFrame:
    """Those of the first records by id that have dates: ``first`` rows at most."""
    return records.select("id", *FIELDS).orderBy("id").limit(first).where(F.coalesce(F.col("dates"), F.lit("")) != "")


def context_of(results: DataFrame, q: DataFrame, records: DataFrame) -> DataFrame:
    """At most ``CONTEXT`` results of each query in three tiers: dates that fit, a keyword in the question, the rest.

    A date fits if it is asked for, or can be the same as one asked for, or, where a question is about dates but names
    none, if there is any.  A question about dates without results takes records whose dates are the very one it names,
    or, where it names none, the first records with dates, uncut.  One none of whose results fits takes those as well.
    """
    wants = F.col("asks_date") | (F.size("asked_dates") > 0)
    meta = q.select("query_id", "query_text", "asks_date", "asked_dates")
    none = meta.where(wants).join(results.select("query_id").distinct(), "query_id", "left_anti")
    few = F.broadcast(first_dated(records).withColumn("_all", F.lit(1)))  # FIRST rows at most
    as_found = lambda df: df.select("query_id", "id", F.lit(1.0).alias("distance"), *FIELDS, "source")
    # Each date string's records are cut before they meet the queries, in hash parts first, so a date that many share is never sorted whole.
    part = Window.partitionBy("dates", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    exact = records.select("id", *FIELDS).where("dates is not null").withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= EXACT)
    exact = exact.withColumn("_p", F.row_number().over(Window.partitionBy("dates").orderBy("id"))).where(F.col("_p") <= EXACT)
    named = none.select("query_id", F.explode("asked_dates").alias("_d")).join(exact, F.col("_d") == F.col("dates"))
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("_n") <= EXACT).withColumn("source", F.lit("exact"))
    unnamed = none.where(F.size("asked_dates") == 0).withColumn("_all", F.lit(1)).join(few, "_all").withColumn("source", F.lit("first"))
    told = results.select("query_id", "id", "distance", *FIELDS, F.lit("search").alias("source"), "ord", "has_date").join(meta, "query_id")
    partial = F.exists("asked_dates", lambda a: F.exists(date_list(F.col("dates")), lambda d: partial_match(a, d)))
    some = F.size(date_list(F.coalesce("dates", F.lit("")))) > 0
    fits = some & F.when(F.size("asked_dates") > 0, F.col("has_date") | partial).otherwise(F.col("asks_date"))
    key = keyword_relevant(F.split("keywords", ", "), F.col("query_text"))
    told = told.withColumn("tier", F.when(F.coalesce(fits, F.lit(False)), 1).when(key, 2).otherwise(3))
    lacking = told.groupBy("query_id").agg(F.min("tier").alias("_best")).where("_best > 1").select("query_id").join(meta.where(wants), "query_id")
    wider = lacking.withColumn("_all", F.lit(1)).join(few, "_all").join(results.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("source", F.lit("wider"))
    more = as_found(named).unionByName(as_found(unnamed)).unionByName(as_found(wider)).withColumn("tier", F.lit(1)).withColumn("ord", F.col("id"))
    every = told.select("query_id", "id", "distance", *FIELDS, "source", "tier", "ord").unionByName(more)
    w = Window.partitionBy("query_id").orderBy("tier", "distance", F.when(F.col("source") == "search", 0).otherwise(1), "ord")
    return every.withColumn("place", F.row_number().over(w)).where((F.col("place") <= CONTEXT) | (F.col("source") == "first")).drop("ord")


def retrieve(queries: DataFrame, records: DataFrame, n: int = 5, threshold: float = 0.6, same: str | None = None) -> DataFrame:
    """What a question is answered from: query_id, id, distance, rank, from_dates and the records' fields.

    Results within ``1 - threshold``; for questions about dates, what ``context_of`` adds, 2n in all, the former first;
    all results where nothing is left.
    """
    q = asked(queries, same)
    found = stored(fetched(q, records, n, same), "fetched")
    near = found.where(F.col("distance") <= 1 - threshold).select("query_id", "id", "distance", "ord", *FIELDS, F.lit(False).alias("from_dates"))
    about = q.where("asks_date").select("query_id")
    dated = context_of(found, q, records).join(about, "query_id", "left_semi").join(near.select("query_id", "id"), ["query_id", "id"], "left_anti")
    dated = dated.select("query_id", "id", "distance", F.col("place").alias("ord"), *FIELDS, F.lit(True).alias("from_dates"))
    merged = stored(near.unionByName(dated), "merged")
    whole = found.join(merged.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "id", "distance", "ord", *FIELDS, F.lit(False).alias("from_dates"))
    w = Window.partitionBy("query_id").orderBy("from_dates", "distance", "ord")
    limit = F.when(F.col("asks_date"), 2 * n).otherwise(n)
    ranked = merged.unionByName(whole).withColumn("rank", F.row_number().over(w).cast("long")).join(q.select("query_id", "asks_date"), "query_id")
    return ranked.where(F.col("rank") <= limit).select("query_id", "id", "distance", "rank", "from_dates", *FIELDS)
