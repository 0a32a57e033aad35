import pytest

from airloom.operators import sites
from helpers import at, city_frame

NOW = at("2026-03-01")
CANDIDATE = "request_seq long, name string, country string, country_code string, latitude double, longitude double, timezone string"
PATCH = CANDIDATE.replace("request_seq long,", "request_seq long, id string,")


@pytest.fixture
def cities(spark):
    return city_frame(spark, ("london", "London", "United Kingdom", "GB", True),
                      ("york", "Jorvik", "United Kingdom", "GB", True), ("bath", "Bath", "United Kingdom", "GB", False))


def candidate(seq, name, code="GB", latitude=1.0, zone="Europe/London", country="United Kingdom"):
    return (seq, name, country, code, latitude, 2.0, zone)


def reasons(spark, cities, *rows):
    frame = spark.createDataFrame(list(rows), CANDIDATE)
    return {r["request_seq"]: r["reason"] for r in sites.review_candidates(cities, frame).collect()}


def test_create_rules(spark, cities):
    got = reasons(
        spark, cities, candidate(1, " Birmingham "), candidate(2, "LONDON"), candidate(3, "Bath"), candidate(4, "York"),
        candidate(5, "jorvik"), candidate(6, "X", code="gb"), candidate(7, "Y", latitude=91.0), candidate(8, "Z", zone="Mars"),
        candidate(9, "U", zone="UTC"), candidate(10, "東京"), candidate(11, ""), candidate(12, None), candidate(13, "V", country=""))
    assert got == {1: None, 2: "duplicate_name", 3: "duplicate_slug", 4: "duplicate_slug", 5: "duplicate_name",
                   6: "country_code_format", 7: "latitude_range", 8: "timezone_format", 9: None, 10: "empty_slug",
                   11: "name_length", 12: "name_length", 13: "country_length"}


def test_first_request_of_a_batch_takes_the_slug(spark, cities):
    got = reasons(spark, cities, candidate(3, "leeds"), candidate(1, "Leeds", latitude=100.0), candidate(2, "Leeds!"),
                  candidate(4, "LEEDS"))
    assert got == {1: "latitude_range", 2: None, 3: "duplicate_in_batch", 4: "duplicate_in_batch"}


def test_created_rows(spark, cities):
    made = sites.create_sites(cities, spark.createDataFrame([candidate(1, " Birmingham ")], CANDIDATE), NOW)
    row = made.where("id = 'birmingham'").first()
    assert (row["name"], row["is_active"], made.count()) == ("Birmingham", True, 4)


def updated(spark, cities, *patches):
    frame = spark.createDataFrame(list(patches), PATCH)
    rows = {r["id"]: r for r in sites.update_sites(cities, frame, NOW).collect()}
    return rows, {r["id"]: r["reason"] for r in sites.review_patches(cities, frame).collect()}


def patch(seq, city, name=None, code=None, latitude=None, zone=None):
    return (seq, city, name, None, code, latitude, None, zone)


def test_partial_update_keeps_the_rest_and_the_id(spark, cities):
    rows, why = updated(spark, cities, patch(1, "london", name="Greater London"))
    assert (rows["london"]["name"], rows["london"]["country"], why["london"]) == ("Greater London", "United Kingdom", None)
    assert rows["london"]["updated_at"] > rows["london"]["created_at"]
    assert rows["york"]["updated_at"] == rows["york"]["created_at"]


def test_update_rules(spark, cities):
    rows, why = updated(spark, cities, patch(1, "london", name="JORVIK"), patch(2, "bath", name="New"),
                        patch(3, "atlantis", name="A"), patch(4, "york", code="gbr"))
    assert why == {"london": "duplicate_name", "bath": "not_found", "atlantis": "not_found", "york": "country_code_format"}
    assert {r["name"] for r in rows.values()} == {"London", "Jorvik", "Bath"}


def test_updates_of_one_city_are_folded_and_renames_claim_in_order(spark, cities):
    rows, why = updated(spark, cities, patch(1, "london", name="A", latitude=5.0), patch(4, "london", name="B"),
                        patch(2, "york", name="b"))
    assert (rows["london"]["name"], rows["london"]["latitude"]) == ("B", 5.0)
    assert why == {"london": None, "york": "duplicate_in_batch"}


def test_empty_and_same_patches_change_nothing(spark, cities):
    rows, why = updated(spark, cities, patch(1, "london"), patch(2, "york", name="Jorvik"))
    assert why == {"london": None, "york": None}
    assert all(r["updated_at"] == r["created_at"] for r in rows.values())


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_soft_delete_and_lookup(spark, cities):
    after = sites.delete_sites(cities, ids(spark, "london", "bath", "atlantis"), NOW)
    assert {r["id"]: r["is_active"] for r in after.collect()} == {"london": False, "york": True, "bath": False}
    assert after.where("id = 'bath' AND updated_at > created_at").count() == 0
    wanted = ids(spark, "london", "york", "atlantis")
    assert {r["id"] for r in sites.find_sites(after, wanted).collect()} == {"york"}
    assert {r["id"] for r in sites.find_sites(after, wanted, include_inactive=True).collect()} == {"london", "york"}
    assert {r["id"] for r in sites.missing_sites(after, wanted).collect()} == {"london", "atlantis"}


def test_pages(spark, cities):
    assert [r["name"] for r in sites.site_page(cities, 0, 1).collect()] == ["Jorvik"]
    assert [r["name"] for r in sites.site_page(cities, 1, 10).collect()] == ["London"]
    assert tuple(sites.site_page_info(cities, 0, 1).first()) == (2, 0, 1, True)
    assert tuple(sites.site_page_info(cities, 1, 1).first()) == (2, 1, 1, False)
    assert sites.site_page(cities, include_inactive=True).count() == 3
    with pytest.raises(ValueError):
        sites.site_page(cities, -1, 10)


def test_names_resolve_in_order(spark, cities):
    requests = spark.createDataFrame([(1, "LONDON"), (2, " York "), (3, "york!"), (4, "Bath"), (5, "nowhere"), (6, "jorvik")],
                                     "request_seq long, requested_name string")
    resolved = sites.resolve_names(cities, requests)
    assert {r["request_seq"]: r["city_id"] for r in resolved.collect()} == {
        1: "london", 2: "york", 3: "york", 4: None, 5: None, 6: "york"}
    assert {r["request_seq"] for r in sites.unresolved_names(resolved).collect()} == {4, 5}
    assert [r["name"] for r in sites.available_sites(cities).collect()] == ["Jorvik", "London"]
