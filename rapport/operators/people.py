"""Listing, filtering and paging of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.text import sort_name_key


def with_profiles(people: DataFrame, stored: DataFrame) -> DataFrame:
    """People with their profile, or the defaults of somebody never seen."""
    slim = stored.select("person_id", "status", "status_reason", "interaction_count",
                         "interactions_14d", "last_interaction_at")
    zero = F.lit(0).cast("bigint")
    return people.join(slim, "person_id", "left").withColumns({
        "status_reason": F.coalesce("status_reason", F.lit("No recorded interactions yet.")),
        "interaction_count": F.coalesce("interaction_count", zero),
        "interactions_14d": F.coalesce("interactions_14d", zero)})


def text_filter(q: str) -> Column:
    """Case-insensitive substring of the name or of any alias."""
    needle = F.lit(q.lower())
    return (F.contains(F.lower("display_name"), needle)
            | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), needle)), F.lit(False)))


def people_order(sort: str) -> list[Column]:
    """Total orders: the id is always the last key. An unknown sort means 'recent'."""
    digit, natural, person = sort_name_key(F.col("display_name"), F.col("person_id"))
    if sort == "name":
        return [digit, natural, person]
    if sort == "interactions":
        return [F.desc("interaction_count"), digit, natural, person]
    return [F.col("last_interaction_at").desc_nulls_last(), digit.desc(), natural.desc(), person.desc()]


def filtered_people(people: DataFrame, stored: DataFrame, q: str | None = None,
                    status: str | None = None) -> DataFrame:
    rows = with_profiles(people.where(~F.coalesce("is_user", F.lit(False))), stored)
    if q:
        rows = rows.where(text_filter(q))
    return rows.where(F.col("status") == status) if status else rows


def people_page(people: DataFrame, stored: DataFrame, q: str | None = None, status: str | None = None,
                sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page: limit clamped to 1..200, offset to 0 and above."""
    sort = sort if sort in K.PEOPLE_SORTS else "recent"
    limit, offset = max(1, min(limit, K.PEOPLE_PAGE_MAX)), max(0, offset)
    return (filtered_people(people, stored, q, status)
            .orderBy(*people_order(sort)).offset(offset).limit(limit))


def people_total(people: DataFrame, stored: DataFrame, q: str | None = None,
                 status: str | None = None) -> DataFrame:
    return filtered_people(people, stored, q, status).agg(F.count("*").alias("total"))


def people_rail(people: DataFrame, stored: DataFrame, n: int = 6) -> DataFrame:
    """The most active people, shown beside every page."""
    return (filtered_people(people, stored).orderBy(*people_order("interactions")).limit(n)
            .select("person_id", "display_name", "interaction_count"))


def identity_people(people: DataFrame, identities: DataFrame, kind: str, values: DataFrame) -> DataFrame:
    """People owning one of the identity ``values`` (column ``value``) of a kind."""
    hits = identities.where(F.col("kind") == kind).join(values.select("value").distinct(), "value",
                                                        "left_semi")
    return hits.select("person_id", "kind", "value").join(people, "person_id")
