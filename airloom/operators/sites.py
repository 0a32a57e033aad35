"""Bulk maintenance of the city dimension: create, update, deactivate, look up, resolve."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.text import clean, lookup_slug, site_errors, slug
from airloom.functions.times import instant
from airloom.operators.filters import active, page, page_info
from airloom.schemas import CITIES

_EDITABLE = ["name", "country", "country_code", "latitude", "longitude", "timezone"]


def review_candidates(cities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their slug and the reason they cannot be created (NULL when they can).

    ``candidates``: request_seq plus the editable fields. A name may not equal an active city's, ignoring
    case; a slug may not equal any city's, active or not. Within the batch the earliest request that
    passes everything else takes the slug; the same name always gives the same slug.
    """
    names = active(cities).select(F.lower("name").alias("name_key")).distinct().withColumn("name_taken", F.lit(True))
    slugs = cities.select(F.col("id").alias("slug")).distinct().withColumn("slug_taken", F.lit(True))
    checked = (
        candidates.withColumn("errors", site_errors())
        .withColumn("slug", slug(F.col("name")))
        .withColumn("name_key", F.lower("name"))
        .join(names, "name_key", "left")
        .join(slugs, "slug", "left")
        .withColumn("reason", F.when(F.size("errors") > 0, F.element_at("errors", 1))
                    .when(F.col("name_taken"), "duplicate_name")
                    .when(F.col("slug") == "", "empty_slug")
                    .when(F.col("slug_taken"), "duplicate_slug"))
        .drop("name_key", "name_taken", "slug_taken")
    )
    winners = (
        checked.where(F.col("reason").isNull()).groupBy("slug")
        .agg(F.min("request_seq").alias("winner_seq"))
    )
    late = F.col("reason").isNull() & (F.col("request_seq") > F.col("winner_seq"))
    return (
        checked.join(winners, "slug", "left")
        .withColumn("reason", F.when(late, "duplicate_in_batch").otherwise(F.col("reason")))
        .drop("winner_seq")
    )


def created_sites(reviewed: DataFrame, as_of: datetime) -> DataFrame:
    """The rows to append to the dimension."""
    now = instant(as_of)
    return reviewed.where(F.col("reason").isNull()).select(
        F.col("slug").alias("id"), clean(F.col("name")).alias("name"), clean(F.col("country")).alias("country"),
        F.upper("country_code").alias("country_code"), "latitude", "longitude", "timezone",
        F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at"),
    )


def create_sites(cities: DataFrame, candidates: DataFrame, as_of: datetime) -> DataFrame:
    """The dimension with the accepted candidates added."""
    return cities.unionByName(created_sites(review_candidates(cities, candidates), as_of))


def _folded(patches: DataFrame) -> DataFrame:
    """One patch per city: for each field the last value that was supplied."""
    return patches.groupBy("id").agg(
        F.min("request_seq").alias("request_seq"),
        *[F.max_by(name, F.when(F.col(name).isNotNull(), F.col("request_seq"))).alias(name) for name in _EDITABLE],
    )


def review_patches(cities: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial updates with the reason they cannot be applied (NULL when they can).

    ``patches``: request_seq, id and the editable fields, NULL meaning not supplied. Several patches of one
    city are folded field by field. A new name may not belong to another active city, nor be claimed by an
    earlier patch of the batch.
    """
    live = active(cities)
    known = live.select("id", F.col("name").alias("current_name"))
    owners = live.groupBy(F.lower("name").alias("name_key")).agg(
        F.min("id").alias("owner"), F.max("id").alias("other_owner"))
    renaming = F.col("name").isNotNull() & (F.col("name") != F.col("current_name"))
    taken = renaming & ((F.col("owner") != F.col("id")) | (F.col("other_owner") != F.col("id")))
    checked = (
        _folded(patches)
        .withColumn("errors", site_errors(required=False))
        .withColumn("name_key", F.lower("name"))
        .join(known, "id", "left")
        .join(owners, "name_key", "left")
        .withColumn("reason", F.when(F.col("current_name").isNull(), "not_found")
                    .when(F.size("errors") > 0, F.element_at("errors", 1))
                    .when(taken, "duplicate_name"))
        .withColumn("renaming", renaming)
        .drop("owner", "other_owner")
    )
    claims = (
        checked.where(F.col("reason").isNull() & F.col("renaming"))
        .groupBy("name_key").agg(F.min("request_seq").alias("claimed_by"))
    )
    late = F.col("reason").isNull() & F.col("renaming") & (F.col("request_seq") > F.col("claimed_by"))
    return (
        checked.join(claims, "name_key", "left")
        .withColumn("reason", F.when(late, "duplicate_in_batch").otherwise(F.col("reason")))
        .drop("name_key", "claimed_by", "renaming")
    )


def update_sites(cities: DataFrame, patches: DataFrame, as_of: datetime) -> DataFrame:
    """The dimension after the acceptable patches. Ids never change; an empty patch changes nothing."""
    accepted = review_patches(cities, patches).where(F.col("reason").isNull()).select(
        "id", *[F.col(name).alias(f"new_{name}") for name in _EDITABLE])
    differs = F.lit(False)
    for name in _EDITABLE:
        differs = differs | (F.col(f"new_{name}").isNotNull() & (F.col(f"new_{name}") != F.col(name)))
    joined = cities.join(accepted, "id", "left").withColumn("differs", differs)
    edited = {name: F.coalesce(f"new_{name}", name) for name in _EDITABLE}
    edited["updated_at"] = F.when(F.col("differs"), instant(as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns(edited).select(*CITIES.fieldNames())


def delete_sites(cities: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """The dimension with the named active cities switched off; their readings stay."""
    doomed = ids.select("id").distinct().withColumn("doomed", F.lit(True))
    ends = F.col("doomed").isNotNull() & F.col("is_active")
    joined = cities.join(doomed, "id", "left").withColumn("ends", ends)
    return joined.withColumns({
        "is_active": F.col("is_active") & ~F.col("ends"),
        "updated_at": F.when(F.col("ends"), instant(as_of)).otherwise(F.col("updated_at")),
    }).select(*CITIES.fieldNames())


def find_sites(cities: DataFrame, ids: DataFrame, *, include_inactive: bool = False) -> DataFrame:
    """The requested cities; inactive ones count as absent unless asked for."""
    pool = cities if include_inactive else active(cities)
    return pool.join(ids.select("id").distinct(), "id", "left_semi").select(*CITIES.fieldNames())


def missing_sites(cities: DataFrame, ids: DataFrame, *, include_inactive: bool = False) -> DataFrame:
    """The requested ids that are not there."""
    pool = cities if include_inactive else active(cities)
    return ids.select("id").distinct().join(pool.select("id"), "id", "left_anti")


def site_page(cities: DataFrame, skip: int = 0, limit: int = 100, *, include_inactive: bool = False) -> DataFrame:
    pool = cities if include_inactive else active(cities)
    return page(pool, ["name", "id"], skip, limit)


def site_page_info(cities: DataFrame, skip: int = 0, limit: int = 100, *,
                   include_inactive: bool = False) -> DataFrame:
    return page_info(cities if include_inactive else active(cities), skip, limit)


def resolve_names(cities: DataFrame, requests: DataFrame) -> DataFrame:
    """Free-text names matched to active cities: by name ignoring case, then as an id, then as a slug.

    ``requests``: request_seq, requested_name. Unmatched requests keep a NULL city_id.
    """
    pool = active(cities)
    by_name = pool.groupBy(F.lower("name").alias("k_name")).agg(F.min("id").alias("name_match"))
    by_id = pool.select(F.col("id").alias("k_id"), F.col("id").alias("id_match"))
    by_slug = pool.select(F.col("id").alias("k_slug"), F.col("id").alias("slug_match"))
    names = pool.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    requested = F.col("requested_name")
    return (
        requests.withColumns({"k_name": F.lower(requested), "k_id": F.lower(clean(requested)),
                              "k_slug": lookup_slug(requested)})
        .join(by_name, "k_name", "left")
        .join(by_id, "k_id", "left")
        .join(by_slug, "k_slug", "left")
        .withColumn("city_id", F.coalesce("name_match", "id_match", "slug_match"))
        .join(names, "city_id", "left")
        .select("request_seq", "requested_name", "city_id", "city_name")
    )


def unresolved_names(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("city_id").isNull()).select("request_seq", "requested_name")


def available_sites(cities: DataFrame) -> DataFrame:
    """Active cities by name: what an answer about an unknown name offers, and what an ingest cycle works through."""
    return active(cities).orderBy("name", "id")
