"""URL filters: host and path rules first, then a listed-URL set behind a blocked Bloom filter. DataFrame only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import LOWER, UPPER, stored

BLOCKS = 1 << 17  # of four words of 64 bits: the broadcast filter has this many rows at most
WORDS = 4
Rule = tuple[str, str]  # verdict, and host/path

# Parameters that say where a visitor came from, not what the page is.
VISIT_PARAMETERS = r"^(utm_[a-z]+|ref)(=|\z)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, parameters that name the page; null without a host."""
    query = F.array_join(F.filter(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"),
                                  lambda p: (p != "") & ~p.rlike(VISIT_PARAMETERS)), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.rtrim(path_of(url), F.lit("/")),
                                       F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index of the longest rule that fits, null if none does; equally long ones by their text."""
    fits = []
    for number, (_, place) in sorted(enumerate(rules), key=lambda r: (-len(r[1][1]), r[1][1])):
        own, slash, start = place.partition("/")
        fits.append(F.when(((host == own) | host.endswith("." + own)) & path.startswith(slash + start), F.lit(number)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def _masks(canon: Column) -> list[Column]:
    """Two bits in each word of a block."""
    bits = F.xxhash64(F.lit("bits"), canon)

    def bit(number: int) -> Column:
        at = F.shiftrightunsigned(bits, 6 * number).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def _block(canon: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon), F.lit(blocks)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The filter as a table: ``block`` and its words, the bits of all ``canon`` of ``listed`` set."""
    set_bits = [F.bit_or(mask).alias(f"w{w}") for w, mask in enumerate(_masks(F.col("canon")))]
    return listed.groupBy(_block(F.col("canon"), blocks).alias("block")).agg(*set_bits)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], blocks: int = BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict, canon, listed`` for every row of ``pages`` (``page_id``, ``url``).

    The longest rule whose host is the url's or a parent of it and whose path starts the url's decides. Where none
    fits, the url is blocked if its canonical form is among those of ``listed`` (``url``), else allowed. A
    null url or one without ``://`` has empty host and path, no canonical form, and is allowed. Null or useless
    listed urls do not count, repeats are harmless; ids may be null or repeat. Other columns are ignored.

    The filter has ``blocks`` rows at most, so it is broadcast whatever the list's size; a longer list only
    sends more urls to the exact join. Urls that the filter rules out are not moved.
    """
    wanted = stored(listed.select(canonical(F.col("url").cast("string")).alias("canon")).where("canon is not null")
                    .groupBy("canon").agg(F.lit(True).alias("hit")), "urls-listed")
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        canonical(url).alias("canon"))
    rows = rows.withColumn("number", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "block", _block(F.col("canon"), blocks))
    tested = rows.join(F.broadcast(bloom_blocks(wanted, blocks)), "block", "left")  # ``blocks`` rows at most
    inside = reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(m) == m for w, m in enumerate(_masks(F.col("canon")))])
    tested = tested.withColumn("maybe", F.coalesce(inside & F.col("canon").isNotNull(), F.lit(False))).drop(
        "block", *[f"w{w}" for w in range(WORDS)])
    checked = tested.where("maybe").join(wanted, "canon", "left").select(
        "page_id", "host", "path", "canon", "number", F.coalesce("hit", F.lit(False)).alias("listed"))
    ruled_out = tested.where("not maybe").select("page_id", "host", "path", "canon", "number", F.lit(False).alias("listed"))

    def of_rule(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col("number") + 1)

    return checked.union(ruled_out).select(
        "page_id", "host", "path", of_rule([place for _, place in rules]).alias("rule"),
        F.coalesce(of_rule([verdict for verdict, _ in rules]), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canon", "listed")
