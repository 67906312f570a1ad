"""Finding places by what is written: the ladder of name matches, its ranking, addresses, reverse lookup, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralattice.functions import text as X
from terralattice.operators import answers, divisions, places

# Weights of division subtypes, countries with address points, and territories whose points come with another country's; fixed values.
SUBTYPE_WEIGHT = {"locality": 4, "localadmin": 3, "neighborhood": 2, "region": 1, "county": 1, "country": 0, "dependency": 0}
COVERED = (
    "AT", "AU", "BE", "BR", "CA", "CH", "CL", "CO", "CZ", "DE",
    "DK", "EE", "ES", "FI", "FO", "FR", "GL", "HK", "HR", "IS",
    "IT", "JP", "LI", "LT", "LU", "LV", "MX", "NL", "NO", "NZ",
    "PL", "PT", "RS", "SG", "SI", "SK", "TW", "US", "UY",
)
TERRITORY_PARENT = {
    "MQ": "FR", "GP": "FR", "RE": "FR", "GF": "FR", "YT": "FR",
    "NC": "FR", "PF": "FR", "PM": "FR", "BL": "FR", "MF": "FR",
    "AX": "FI",
    "NF": "AU",
}
STRONG_TIER, MAX_ANCHOR_SPAN = 2, 3.0
ADDRESS_REACH, BUILDING_REACH, COUNT_CAP = 5000.0, 100.0, 25


def _tier(name: Column, query: Column) -> Column:
    """3 exact, 2 beginning, 1 inside, null else; both are folded."""
    return F.when(query == "", None).when(name == query, 3).when(name.startswith(query), 2).when(name.contains(query), 1)


def _meeting(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Names (folded) and queries (folded) with a common beginning-of-query gram, so that any match of a tier is among them."""
    starts = lambda c: F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    grams = F.array_distinct(
        F.flatten(F.transform(starts(F.col("folded")), lambda i: F.array(*(F.substr(F.col("folded"), i, F.lit(n)) for n in (1, 2, 3)))))
    )
    # The stated queries are broadcast, so that the names' grams are looked up where they are made and never shuffled.
    return names.withColumn("_g", F.explode(grams)).join(F.broadcast(asked.withColumn("_g", F.substr("wanted", F.lit(1), F.lit(3)))), "_g").drop("_g")


def candidates(names: DataFrame, alternates: DataFrame, queries: DataFrame, threshold: float = X.FUZZY_THRESHOLD) -> DataFrame:
    """query, id, tier, variant, fuzzy, similarity: the rungs of the ladder.

    A state behind the name keeps that region's divisions only.  Literal matches come first; spellings with one word in another form join them
    where no literal match is strong; alternate names count as variants; similar names are tried only where all else found nothing.
    ``names``: id, name, region; ``alternates``: id, folded; ``queries``: query, a stated set.
    """
    base, state = X.region_suffix(F.col("query"))
    asked = queries.select("query", base.alias("base"), state.alias("state")).withColumn("wanted", X.fold(F.col("base")))
    folded = names.select("id", "region", X.fold(F.col("name")).alias("folded"))
    there = F.col("state").isNull() | (F.col("region") == F.concat(F.lit("US-"), "state"))
    literal = _meeting(folded, asked).withColumn("tier", _tier(F.col("folded"), F.col("wanted"))).filter(there & F.col("tier").isNotNull())
    found = literal.select("query", "id", "tier", F.lit(0).alias("variant"))

    strong = found.groupBy("query").agg(F.max("tier").alias("best")).filter(F.col("best") >= STRONG_TIER).select("query")
    spelled = (
        asked.join(strong, "query", "left_anti")
        .select("query", "state", F.explode(X.name_variants(F.col("base"))).alias("v"))
        .select("query", "state", X.fold(F.col("v")).alias("wanted"))
    )
    by_variant = _meeting(folded, spelled).withColumn("tier", _tier(F.col("folded"), F.col("wanted"))).filter(there & F.col("tier").isNotNull())
    # Names in a column or two look small enough to broadcast by the size of their file, and are not; joins by id merge.
    aliased = alternates.select("id", F.col("folded").alias("wanted")).join(F.broadcast(asked), "wanted")
    by_alternate = aliased.join(names.select("id", "region").hint("merge"), "id").filter(there)
    every = (
        found.unionAll(by_variant.select("query", "id", "tier", F.lit(1).alias("variant")))
        .unionAll(by_alternate.select("query", "id", F.lit(3).alias("tier"), F.lit(1).alias("variant")))
        .groupBy("query", "id")
        .agg(F.min(F.struct("variant", (-F.col("tier")).alias("t"))).alias("b"))
        .select("query", "id", (-F.col("b.t")).alias("tier"), "b.variant", F.lit(0).alias("fuzzy"), F.lit(None).cast("double").alias("similarity"))
    )
    # The stated queries that found nothing are few; each meets every name, as similarity has no key.
    nothing = asked.filter("wanted <> ''").join(every.select("query").distinct(), "query", "left_anti")
    near = (
        folded.crossJoin(F.broadcast(nothing))
        .filter(there)
        .withColumn("similarity", X.jaro_winkler(F.col("folded"), F.col("wanted")))
        .filter(F.col("similarity") >= threshold)
    )
    return every.unionAll(near.select("query", "id", F.lit(1).alias("tier"), F.lit(0).alias("variant"), F.lit(1).alias("fuzzy"), "similarity"))


def geocode(names: DataFrame, alternates: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query, rank, id, tier, score of the best divisions for each query.

    ``names``: id, name, subtype, region, population, depth (entries of its admin chain); ``alternates``: id, folded.
    The order is by: fuzzy last, similarity, strong tiers first, a population above 0 first, tier, a known population first, population, weight
    of the subtype, depth, the region's population, literal first, id.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SUBTYPE_WEIGHT.items() for x in kv)), F.col("subtype")), F.lit(0))
    of_region = names.filter("subtype = 'region'").groupBy(F.col("region").alias("_region")).agg(F.max("population").alias("region_population"))
    known = names.select("id", "subtype", "region", "population", "depth", weight.alias("weight"))
    rows = candidates(names, alternates, queries).join(known.hint("merge"), "id")
    rows = rows.join(of_region, F.col("region") == F.col("_region"), "left")
    people = F.coalesce("population", F.lit(0))
    order = Window.partitionBy("query").orderBy(
        "fuzzy", F.desc(F.coalesce("similarity", F.lit(0.0))), (F.col("tier") < STRONG_TIER), (people <= 0), F.desc("tier"),
        F.col("population").isNull(), F.desc(people), F.desc("weight"), "depth", F.desc(F.coalesce("region_population", F.lit(0))), "variant", "id",
    )
    base = F.when(F.col("fuzzy") == 1, 0.3).when(F.col("tier") == 3, 1.0).when(F.col("tier") == 2, 0.7).otherwise(0.4)
    bonus = F.when(people > 0, F.least(F.lit(0.05), F.log10(people + F.lit(1.0)) / 140)).otherwise(0.0)
    score = base + F.col("weight") * 0.01 + bonus - F.col("variant") * 0.01
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query", "rank", "id", "tier", F.round(score, 3).alias("score"))
    )


def rank_places(df: DataFrame, residual: str, whole: str) -> DataFrame:
    """df (id, name, confidence, distance) in the order of the place fallback: tier of the better reading, whole kilometres, confidence, id."""
    tier = lambda q: F.coalesce(_tier(X.fold(F.col("name")), X.fold(F.lit(q))), F.lit(1))
    order = Window.orderBy(F.desc("tier"), "km", F.desc(F.coalesce("confidence", F.lit(0.0))), "id")
    rows = df.withColumn("tier", F.greatest(tier(residual), tier(whole))).withColumn("km", F.round(F.col("distance") / 1000))
    # The rows are those of one bounded scan around an anchor.
    return rows.withColumn("rank", F.row_number().over(order))


def anchor_splits(queries: DataFrame) -> DataFrame:
    """query, place, rest: readings of 'what and where': the last two and the last word as the place, then leading words and pairs.

    What is left must hold a word that is no stop word.
    """
    w = F.filter(F.split(F.trim("query"), r"\s+"), lambda x: x != "")
    n = F.size(w)
    part = lambda i, k: F.array_join(F.slice(w, i, k), " ")
    pick = lambda place, rest, order: F.struct(F.lit(order).alias("order"), place.alias("place"), rest.alias("rest"))
    zero = F.lit(0)
    around = lambda i, k: F.trim(F.concat_ws(" ", part(F.lit(1), i), part(i + k + 1, F.greatest(n - i - k, zero))))
    tails = [F.when(n > k, pick(part(n - k + 1, F.lit(k)), part(F.lit(1), n - k), 2 - k)) for k in (2, 1)]
    inner = F.when(n > 1, F.sequence(zero, n - 2)).otherwise(F.array().cast("array<int>"))
    usable = lambda i: (n <= 6) & (F.length(F.get(w, i)) >= 3) & ~F.lower(F.get(w, i)).isin(*X.STOPWORDS)
    singles = F.transform(F.filter(inner, usable), lambda i: F.struct((i + 2).alias("order"), F.get(w, i).alias("place"), around(i, F.lit(1)).alias("rest")))
    found = F.concat(F.array_compact(F.array(*tails)), singles)
    named = lambda rest: F.exists(F.split(rest, " "), lambda x: ~F.lower(x).isin(*X.STOPWORDS, ""))
    return queries.select("query", F.explode(F.filter(found, lambda s: named(s["rest"]))).alias("s")).select("query", "s.order", "s.place", "s.rest")


def find_addresses(addresses: DataFrame, anchors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query, rank and a distinct address: those in the place named behind the comma, on a street spelled in any of its forms.

    ``anchors``: name, xmin, ymin, xmax, ymax, lat, lon; wider ones than three degrees are not searched.  Streets match by their beginning,
    a number in full; one row per number, street and postcode, nearest to the anchor first.
    """
    number, street, place = X.parse_address(F.col("query"))
    asked = queries.select("query", number.alias("wanted_number"), F.explode(X.street_variants(street)).alias("form"), X.fold(place).alias("place"))
    fine = anchors.filter((F.col("xmax") - F.col("xmin") <= MAX_ANCHOR_SPAN) & (F.col("ymax") - F.col("ymin") <= MAX_ANCHOR_SPAN))
    aimed = asked.join(fine.select(X.fold(F.col("name")).alias("place"), "xmin", "ymin", "xmax", "ymax", F.col("lat").alias("a"), F.col("lon").alias("b")), "place")
    # A stated set of queries with their spellings, each within one box; the first word of the street makes it an equi-join.
    head = lambda c: F.lower(F.substring_index(c, " ", 1))
    near = addresses.withColumn("_h", head(F.col("street"))).join(F.broadcast(aimed.withColumn("_h", head(F.col("form")))), "_h")
    hits = near.filter(
        F.lower("street").startswith(F.lower("form"))
        & F.col("lon").between(F.col("xmin"), F.col("xmax"))
        & F.col("lat").between(F.col("ymin"), F.col("ymax"))
        & (F.col("wanted_number").isNull() | (F.lower("number") == F.lower("wanted_number")))
    )
    distance = places.haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lon"))
    once = hits.groupBy("query", "number", "street", "postcode").agg(
        F.when(F.countDistinct("unit") == 1, F.min("unit")).alias("unit"), F.min(F.round(distance, 1)).alias("distance")
    )
    order = Window.partitionBy("query").orderBy("distance", "number", "street", "postcode")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def reverse(points: DataFrame, addresses: DataFrame, areas: DataFrame) -> DataFrame:
    """id, source, address, distance, division: the nearest address within 5 km, if there is one, and the smallest division around the point."""
    near = places.nearest_join(points, addresses, ADDRESS_REACH).select("id", F.col("near_id").alias("address"), "distance")
    around = divisions.chain(divisions.containing(points, areas)).filter("level = 1").select("id", F.col("name").alias("division"))
    source = F.when(F.col("address").isNotNull(), "address").otherwise("divisions_only")
    return points.select("id").join(near, "id", "left").join(around, "id", "left").withColumn("source", source)


def coverage(country: Column) -> Column:
    """Whether a country's, or its territory's parent's, address points are in the data."""
    parents = F.create_map(*(F.lit(x) for kv in TERRITORY_PARENT.items() for x in kv))
    home = F.coalesce(F.try_element_at(parents, country), country)
    return F.when(country.isNull(), "unknown").when(home.isin(*COVERED), "covered").otherwise("not covered")


def related(entities: DataFrame, areas: DataFrame, buildings: DataFrame) -> DataFrame:
    """id, division_id, building_id, building_distance: the smallest division around each entity, and the nearest building within 100 m."""
    around = divisions.chain(divisions.containing(entities, areas)).filter("level = 1").select("id", F.col("area_id").alias("division_id"))
    near = places.nearest_join(entities, buildings, BUILDING_REACH).select(
        "id", F.col("near_id").alias("building_id"), F.round("distance", 0).alias("building_distance")
    )
    return entities.select("id").join(around, "id", "left").join(near, "id", "left")


def verify(claims: DataFrame, df: DataFrame) -> DataFrame:
    """id, verdict, measured of claims (id, kind, lat, lon, category, radius, claimed) about places.

    'distance': the nearest of the category is within ``claimed`` metres; 'count': at least ``claimed`` lie within ``radius``, a count that
    stops at 25 cannot refute more; 'travel': as distance, in straight minutes at a walk.  What is not found is false.
    """
    from terralattice.functions.geo import covering_cells, grid_cell, haversine

    reach = 2000.0
    asked = claims.withColumn("_cell", F.explode(covering_cells(F.col("lat"), F.col("lon"), reach, reach)))
    there = df.select(
        F.lower("category").alias("_c"), F.col("lat").alias("_a"), F.col("lon").alias("_b"), grid_cell(F.col("lat"), F.col("lon"), reach).alias("_cell")
    )
    away = haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_b"))
    near = (
        asked.join(there, "_cell")
        .filter(F.col("_c") == F.lower("category"))
        .withColumn("m", away)
        .filter(F.col("m") <= F.least(F.lit(reach), F.coalesce("radius", F.lit(reach))))
    )
    found = near.groupBy("id").agg(F.min(F.round("m", 0)).alias("nearest"), F.count(F.lit(1)).alias("n"))
    rows = claims.join(found, "id", "left")
    minutes = F.col("nearest") / 84.0
    count = F.least(F.coalesce("n", F.lit(0)), F.lit(COUNT_CAP))
    distance = F.coalesce(answers.grade(F.col("nearest"), F.col("claimed")), F.lit("false"))
    travel = answers.grade(minutes, F.col("claimed"))
    none = F.col("nearest").isNull()
    verdict = (
        F.when(F.col("kind") == "count", answers.grade_count(count, F.col("claimed"), COUNT_CAP))
        .when(none, "false")
        .when(F.col("kind") == "distance", distance)
        .otherwise(travel)
    )
    measured = F.when(F.col("kind") == "count", count.cast("double")).when(F.col("kind") == "distance", F.col("nearest")).otherwise(F.round(minutes, 1))
    return rows.select("id", verdict.alias("verdict"), measured.alias("measured"))


def resolve(query: str, divisions_found: DataFrame, df: DataFrame, lat: float, lon: float, limit: int = 5) -> DataFrame:
    """rank, kind, id, label, km of what a query may mean: geocoded divisions (id, name, tier, population, lat, lon), and places (id, name, confidence,
    lat, lon) whose names hold one of its words; the same name of a kind counts once.

    The order is by label (3 exact to 1 inside), whole kilometres from a point, prominence, kind and id.
    """
    from terralattice.functions.geo import haversine

    wanted = X.fold(F.lit(query))
    words = F.filter(X.tokens(F.lit(query)), lambda w: F.length(w) > 0)
    away = F.round(haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) / 1000)
    a = divisions_found.select(F.lit("division").alias("kind"), "id", "name", F.col("tier").alias("label"), away.alias("km"), F.log10(F.coalesce("population", F.lit(0)) + 1.0).alias("fame"))
    hit = F.exists(words, lambda w: F.contains(X.fold(F.col("name")), X.fold(w)))
    label = F.coalesce(_tier(X.fold(F.col("name")), wanted), F.lit(1))
    b = df.filter(hit).select(F.lit("place").alias("kind"), "id", "name", label.alias("label"), away.alias("km"), F.coalesce("confidence", F.lit(0.0)).alias("fame"))
    order = [F.desc("label"), "km", F.desc("fame"), "kind", "id"]
    once = places.first_by(a.unionByName(b), ["kind", "name"], order)
    return once.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
