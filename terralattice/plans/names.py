"""Queries on names, text, categories, addresses and releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralattice.functions import text as X
from terralattice.functions.geo import haversine
from terralattice.operators import changes as C
from terralattice.operators import names as N
from terralattice.plans import geography as G
from terralattice.plans._register import ADDRESSES_SQL, LAT, LON, PLACES_SQL, query, sql_from_centre

_NAMES = """divisions AS (
  SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'Łódź ' WHEN 1 THEN 'Zürich ' WHEN 2 THEN 'São João ' WHEN 3 THEN 'Москва ' ELSE 'Plain ' END || CAST(n_nationkey AS VARCHAR) AS name,
    CASE n_nationkey % 5 WHEN 0 THEN 'Lódz ' WHEN 1 THEN 'ZURICH ' WHEN 2 THEN 'Sankt Johann ' WHEN 3 THEN 'Moscow ' ELSE 'Flat ' END || CAST(n_nationkey AS VARCHAR) AS alt_a,
    'Nation ' || CAST(n_nationkey AS VARCHAR) AS alt_b,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS population FROM nation)"""


def _divisions(spark, sf_dir):
    n, k = G.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    of = lambda *names: F.concat(F.get(F.array(*map(F.lit, names)), (k % 5).cast("int")), k.cast("string"))
    people = G.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    return n.join(people, F.col("c_nationkey") == k, "left").select(
        k.alias("id"),
        of("Łódź ", "Zürich ", "São João ", "Москва ", "Plain ").alias("name"),
        F.create_map(
            F.lit("a"), of("Lódz ", "ZURICH ", "Sankt Johann ", "Moscow ", "Flat "), F.lit("b"), F.concat(F.lit("Nation "), k.cast("string"))
        ).alias("common"),
        F.coalesce("population", F.lit(0)).alias("population"),
    )


_FOLD = "lower(strip_accents({}))"
_ALTS = f"""{_NAMES}, spelled AS (SELECT id, name, unnest([alt_a, alt_b]) AS alt FROM divisions),
alts AS (SELECT id, {_FOLD.format('alt')} AS folded, min(alt) AS alt FROM spelled WHERE {_FOLD.format('alt')} <> {_FOLD.format('name')} GROUP BY 1, 2)"""


@query("a12_alt_names_build", f"WITH {_ALTS} SELECT id, folded, alt FROM alts")
def a12_alt_names_build(spark, sf_dir):
    return N.alternate_names(_divisions(spark, sf_dir)).select("id", "folded", "alt")


@query(
    "j01_alt_name_lookup",
    f"WITH {_ALTS} SELECT q AS query, alts.id AS id, alts.alt AS alt, population FROM (VALUES ('nation 7'), ('MOSCOW 3'), ('flat 4'), ('nowhere')) t(q) JOIN alts ON folded = {_FOLD.format('q')} JOIN divisions d ON d.id = alts.id",
)
def j01_alt_name_lookup(spark, sf_dir):
    d = _divisions(spark, sf_dir)
    asked = spark.createDataFrame([("nation 7",), ("MOSCOW 3",), ("flat 4",), ("nowhere",)], "query string")
    return N.by_alternate(d.select("id", "population"), N.alternate_names(d), asked).select("query", "id", "alt", "population")


_ASKED = ("zurich", "plain 4", "sao", "lodz", "4", "ur", "МОСКВА")


@query(
    "t02_geocode_rank",
    f"""WITH {_NAMES}, q AS (SELECT * FROM (VALUES {", ".join(f"('{q}')" for q in _ASKED)}) t(query)),
    t AS (SELECT query, id, population, CASE WHEN {_FOLD.format('name')} = {_FOLD.format('query')} THEN 3
      WHEN starts_with({_FOLD.format('name')}, {_FOLD.format('query')}) THEN 2 WHEN contains({_FOLD.format('name')}, {_FOLD.format('query')}) THEN 1 END AS tier
      FROM q, divisions)
    SELECT query, id, tier, CAST(row_number() OVER (PARTITION BY query ORDER BY tier DESC, population DESC, id) AS INTEGER) AS rank FROM t WHERE tier IS NOT NULL""",
)
def t02_geocode_rank(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in _ASKED], "query string")
    return N.tiered(_divisions(spark, sf_dir), asked).filter(X.fold(F.col("name")) != "").dropDuplicates(["query", "id"]).select(
        "query", "id", "tier", "rank"
    )


@query(
    "e28_rank_score",
    f"WITH {_NAMES} SELECT id, round(1e0 + 3e-2 + least(5e-2, log10(population + 1e0) / 140e0) - CASE WHEN id % 2 = 0 THEN 1e-2 ELSE 0e0 END, 6) AS score FROM divisions",
)
def e28_rank_score(spark, sf_dir):
    d = _divisions(spark, sf_dir)
    score = N.rank_score(F.lit(3), F.lit(3.0), F.col("population"), F.col("id") % 2 == 0, F.lit(False))
    return d.select("id", F.round(score, 6).alias("score"))


@query("e02_fold_text", f"SELECT doc_id, sha256({_FOLD.format('text')}) AS folded FROM documents")
def e02_fold_text(spark, sf_dir):
    return G.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(X.fold(F.col("text")), "UTF-8"), 256).alias("folded"))


_SPELLED = ("Straße Øre ", "Łódź þorn ", "Ægir œuf ", "Đà Nẵng ", "Ёлка й ", "Άθήνα ώ ", "Ħamrun ığdır ", "Ærø Ǻ ế ")


def _spelled(spark, sf_dir):
    k = F.col("n_nationkey")
    raw = F.concat(F.get(F.array(*map(F.lit, _SPELLED)), (k % len(_SPELLED)).cast("int")), "n_name")
    return G.table(spark, sf_dir, "nation").select(k.alias("id"), raw.alias("x"))


_SPELLED_SQL = f"s AS (SELECT n_nationkey AS id, (ARRAY[{', '.join(repr(x) for x in _SPELLED)}])[n_nationkey % {len(_SPELLED)} + 1] || n_name AS x FROM nation)"


@query("e02_fold_scripts", f"WITH {_SPELLED_SQL} SELECT id, {_FOLD.format('x')} AS folded FROM s")
def e02_fold_scripts(spark, sf_dir):
    return _spelled(spark, sf_dir).select("id", X.fold(F.col("x")).alias("folded"))


@query(
    "e03_fold_extended",
    f"""WITH {_SPELLED_SQL} SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({_FOLD.format("x")}, 'ß', 'ss'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd'), 'ð', 'd'), 'þ', 'th'), 'æ', 'ae'), 'œ', 'oe'), 'ħ', 'h'), 'ı', 'i') AS folded FROM s""",
)
def e03_fold_extended(spark, sf_dir):
    return _spelled(spark, sf_dir).select("id", X.fold_extended(F.col("x")).alias("folded"))


@query(
    "e04_fuzzy_names",
    """WITH q AS (SELECT * FROM (VALUES ('smal ring'), ('redd widget'), ('large bolt')) t(query)), n AS (SELECT DISTINCT p_name AS name FROM part)
    SELECT query, name, round(jaro_winkler_similarity(name, query), 6) AS similarity FROM q, n
    WHERE jaro_winkler_similarity(name, query) >= 92e-2""",
)
def e04_fuzzy_names(spark, sf_dir):
    asked = spark.createDataFrame([("smal ring",), ("redd widget",), ("large bolt",)], "query string")
    found = N.fuzzy(G.places(spark, sf_dir), asked)
    return found.select("query", "name", F.round("similarity", 6).alias("similarity"))


@query(
    "e07_tokenize_text",
    rf"""WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' near The ' || p_type || ' of x' WHEN 1 THEN 'by the and of it' ELSE 'ab of' END AS t FROM part),
    w AS (SELECT id, t, list_filter(regexp_extract_all(t, '[\w''-]+'), lambda v: length(v) >= 3) AS ws FROM x),
    k AS (SELECT id, t, ws, list_filter(ws, lambda v: lower(v) NOT IN ({', '.join(repr(s) for s in X.STOPWORDS)})) AS kept FROM w)
    SELECT id, array_to_string((CASE WHEN len(kept) > 0 THEN kept WHEN len(ws) > 0 THEN ws ELSE [t] END)[:12], '|') AS tokens FROM k""",
)
def e07_tokenize_text(spark, sf_dir):
    k = F.col("p_partkey")
    whole = F.when(k % 3 == 0, F.concat("p_name", F.lit(" near The "), "p_type", F.lit(" of x"))).when(k % 3 == 1, "by the and of it").otherwise("ab of")
    return G.table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(X.tokens(whole), "|").alias("tokens"))


_TOWNS = ("Springfield, IL", "Springfield MA", "Springfield, Illinois", "Salem Oregon", "Paris, New York", "Kansas", "St. Paul, mn.", "Lyon, France", "Big Sur, Monterey, ca")
_STATES_SQL = "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in X.STATES.items()) + ") v(code, state))"


@query(
    "e08_region_suffix",
    rf"""WITH {_STATES_SQL}, x AS (SELECT c_custkey AS id, (ARRAY[{', '.join(map(repr, _TOWNS))}])[c_custkey % {len(_TOWNS)} + 1] AS t FROM customer),
    y AS (SELECT id, t, trim(regexp_extract(t, '^(.*),', 1)) AS b, trim(regexp_extract(t, ',([^,]*)$', 1)) AS a, trim(regexp_extract(t, '^(.*\S)\s+\S+$', 1)) AS h, regexp_extract(t, '\s(\S+)$', 1) AS l FROM x)
    SELECT y.id AS id, CASE WHEN s.code IS NOT NULL THEN b WHEN w.code IS NOT NULL THEN h ELSE t END AS name, coalesce(s.code, w.code) AS state FROM y
    LEFT JOIN st s ON b <> '' AND a <> '' AND (upper(rtrim(a, '.')) = s.code OR lower(rtrim(a, '.')) = lower(s.state))
    LEFT JOIN st w ON h <> '' AND l <> '' AND (upper(rtrim(l, '.')) = w.code OR lower(rtrim(l, '.')) = lower(w.state))""",
)
def e08_region_suffix(spark, sf_dir):
    k = F.col("c_custkey")
    name, state = X.region_suffix(F.get(F.array(*map(F.lit, _TOWNS)), (k % len(_TOWNS)).cast("int")))
    return G.table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), state.alias("state"))


_FORMS_SQL = "forms AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{key}', {i}, '{form}')"
    for key, forms in X._merged(X.NAME_FORMS, X.STREET_FORMS, X.QUADRANT_FORMS, X.ORDINAL_WORDS, X.CARDINAL_FORMS).items()
    for i, form in enumerate(forms, 1)
) + ") v(key, pos, form))"


@query(
    "e09_street_variants",
    f"""WITH {_FORMS_SQL}, s AS (SELECT c_custkey AS id, (ARRAY['West', 'N', 'Saint', 'Old'])[c_custkey % 4 + 1] AS a,
      CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 120 AS VARCHAR) WHEN 1 THEN CAST(c_custkey % 120 AS VARCHAR) || 'th' ELSE 'Fifth' END AS b,
      (ARRAY['Street', 'Ave.', 'Pl', 'Broadway', 'NW'])[c_custkey % 5 + 1] AS c FROM customer),
    t AS (SELECT id, 1 AS n, a AS w FROM s UNION ALL SELECT id, 2, b FROM s UNION ALL SELECT id, 3, c FROM s),
    c AS (SELECT id, n, 0 AS pos, w AS form FROM t UNION ALL SELECT id, n, pos, form FROM t JOIN forms ON key = lower(trim(w, '.'))
      UNION ALL SELECT id, n, 50, CASE WHEN w LIKE '%th' THEN replace(w, 'th', '') ELSE w || CASE WHEN CAST(w AS INT) % 100 BETWEEN 10 AND 13 THEN 'th'
        ELSE CASE CAST(w AS INT) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END END FROM t WHERE regexp_matches(w, '^[0-9]+(th)?$')),
    p AS (SELECT a.id AS id, a.form || ' ' || b.form || ' ' || d.form AS x, row_number() OVER (PARTITION BY a.id ORDER BY a.pos, b.pos, d.pos) AS r
      FROM c a JOIN c b ON a.id = b.id AND b.n = 2 JOIN c d ON a.id = d.id AND d.n = 3 WHERE a.n = 1),
    f AS (SELECT id, x, r, row_number() OVER (PARTITION BY id, lower(x) ORDER BY r) AS k FROM p WHERE r <= 24)
    SELECT id, string_agg(x, '|' ORDER BY r) AS spellings FROM f WHERE k = 1 GROUP BY id""",
)
def e09_street_variants(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    number = (k % 120).cast("string")
    middle = F.when(k % 3 == 0, number).when(k % 3 == 1, F.concat(number, F.lit("th"))).otherwise("Fifth")
    text = F.concat_ws(" ", pick("West", "N", "Saint", "Old"), middle, pick("Street", "Ave.", "Pl", "Broadway", "NW"))
    return G.table(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(X.street_variants(text), "|").alias("spellings"))


_PLACE_NAMES = ("St. Louis", "North Hollywood", "Mount St Helens", "N Saint Ft", "Paris")


@query(
    "e09_name_variants",
    f"""WITH {_FORMS_SQL}, s AS (SELECT n_nationkey AS id, (ARRAY[{', '.join(map(repr, _PLACE_NAMES))}])[n_nationkey % {len(_PLACE_NAMES)} + 1] AS name FROM nation),
    w AS (SELECT id, name, string_split(name, ' ') AS ws, unnest(generate_series(1, len(string_split(name, ' ')))) AS i FROM s),
    v AS (SELECT id, i, pos, array_to_string(ws[:i - 1] || [form] || ws[i + 1:], ' ') AS x, name FROM w JOIN forms ON key = lower(trim(ws[i], '.'))
      WHERE key IN ('st', 'saint', 'ft', 'fort', 'mt', 'mount') AND form NOT IN ('Street') OR (i = 1 AND key IN ('n', 'north', 's', 'south', 'e', 'east', 'w', 'west'))),
    f AS (SELECT id, x, i, pos, row_number() OVER (PARTITION BY id, lower(x) ORDER BY i, pos) AS k FROM v WHERE lower(x) <> lower(name))
    SELECT s.id AS id, coalesce((SELECT string_agg(x, '|' ORDER BY i, pos) FROM f WHERE f.id = s.id AND k = 1), '') AS spellings FROM s""",
)
def e09_name_variants(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.get(F.array(*map(F.lit, _PLACE_NAMES)), (k % len(_PLACE_NAMES)).cast("int"))
    return G.table(spark, sf_dir, "nation").select(k.alias("id"), F.array_join(X.name_variants(name), "|").alias("spellings"))


_CODES = ("1011ab", "1011 AB", " sw1a  1aa ", "SW1A1AA", "m5v3l9", "12345-6789", "none", "2100")
_SHAPED = " OR ".join(f"regexp_matches(t, '{shape}')" for shape in X.POSTCODE_SHAPES)


@query(
    "e10_postcode_variants",
    rf"""WITH {ADDRESSES_SQL}, x AS (SELECT id, CASE WHEN id % 9 = 8 THEN postcode ELSE (ARRAY[{', '.join(map(repr, _CODES))}])[id % 9 + 1] END AS c FROM addresses),
    y AS (SELECT id, upper(regexp_replace(trim(c), '\s+', ' ', 'g')) AS t FROM x),
    v AS (SELECT id, t, ({_SHAPED}) AS shaped, CASE WHEN contains(t, ' ') THEN replace(t, ' ', '') WHEN regexp_matches(t, '[A-Z]')
      THEN CASE WHEN regexp_matches(t, '^\d{{4}}[A-Z]{{2}}$') THEN t[:4] || ' ' || t[5:] WHEN length(t) >= 5 THEN t[:-4] || ' ' || t[-3:] END END AS o FROM y)
    SELECT id, shaped, CASE WHEN shaped THEN array_to_string(list_sort(list_distinct(list_filter([t, o], lambda z: z IS NOT NULL))), '|') END AS spellings FROM v""",
)
def e10_postcode_variants(spark, sf_dir):
    code = F.when(F.col("id") % 9 == 8, F.col("postcode")).otherwise(F.get(F.array(*map(F.lit, _CODES)), (F.col("id") % 9).cast("int")))
    return G.addresses(spark, sf_dir).select(
        "id", X.is_postcode(code).alias("shaped"), F.array_join(X.postcode_variants(code), "|").alias("spellings")
    )


_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    "e11_address_parse",
    rf"""WITH {ADDRESSES_SQL}, x AS (SELECT id, CASE id % 7 WHEN 0 THEN number || ' ' || street || ', ' || postal_city WHEN 1 THEN street || ' ' || number || 'B, ' || postal_city
      WHEN 2 THEN 'Calle ' || number || ', ' || postal_city WHEN 3 THEN number || ' de ' || street WHEN 4 THEN 'County Road ' || number || ', a, , b'
      WHEN 5 THEN number ELSE number || ' Highway 101, ' || postal_city END AS whole FROM addresses),
    y AS (SELECT id, list_transform(string_split(whole, ','), lambda v: trim(v)) AS parts FROM x),
    z AS (SELECT id, parts[1] AS half, array_to_string(list_filter(parts[2:], lambda v: v <> ''), ', ') AS place, list_filter(string_split_regex(parts[1], '\s+'), lambda v: v <> '') AS w FROM y),
    f AS (SELECT *, len(w) >= 2 AND regexp_matches(w[1], '^\d+[A-Za-z]?$') AND lower(w[2]) NOT IN ({_IN(X.STREET_PARTICLES)}) AS leads,
      len(w) >= 2 AND regexp_matches(w[-1], '^\d+[A-Za-z]?$') AND lower(w[1]) NOT IN ({_IN(X.LEADING_STREET_TYPES)}) AND lower(w[1] || ' ' || w[2]) NOT IN ({_IN(X.LEADING_STREET_PAIRS)}) AS trails FROM z)
    SELECT id, CASE WHEN leads THEN w[1] WHEN trails THEN w[-1] END AS number, CASE WHEN leads THEN array_to_string(w[2:], ' ') WHEN trails THEN array_to_string(w[:-2], ' ') ELSE half END AS street,
    CASE WHEN place <> '' THEN place END AS place FROM f""",
)
def e11_address_parse(spark, sf_dir):
    k, number, street, city = F.col("id") % 7, F.col("number"), F.col("street"), F.col("postal_city")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    whole = (
        F.when(k == 0, cat(number, " ", street, ", ", city)).when(k == 1, cat(street, " ", number, "B, ", city)).when(k == 2, cat("Calle ", number, ", ", city))
        .when(k == 3, cat(number, " de ", street)).when(k == 4, cat("County Road ", number, ", a, , b")).when(k == 5, number)
        .otherwise(cat(number, " Highway 101, ", city))
    )
    n, s, p = X.parse_address(whole)
    return G.addresses(spark, sf_dir).select("id", n.alias("number"), s.alias("street"), p.alias("place"))


@query(
    "e13_whole_phrase",
    r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])in the([^a-z]|$)')",
)
def e13_whole_phrase(spark, sf_dir):
    return G.table(spark, sf_dir, "documents").filter(X.has_phrase(F.col("text"), "in the")).select("doc_id")


#: A taxonomy out of the parts' names: a slug for each, below the word for the thing; its words are the name's.
_TAX_SQL = "tax AS (SELECT DISTINCT replace(p_name, ' ', '_') AS slug, [split_part(p_name, ' ', 2), replace(p_name, ' ', '_')] AS path, p_name AS words FROM part)"


def _taxonomy(spark, sf_dir):
    name = F.col("p_name")
    slug = F.replace(name, F.lit(" "), F.lit("_"))
    return G.table(spark, sf_dir, "part").select(slug.alias("slug"), F.array(F.split(name, " ")[1], slug).alias("path"), name.alias("words")).distinct()


_IDF = f"""{_TAX_SQL}, tok AS (SELECT DISTINCT slug, unnest(string_split(words, ' ')) AS token FROM tax), every AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tax),
df AS (SELECT token, count(DISTINCT slug) AS df, CASE WHEN length(token) > 3 AND token LIKE '%s' THEN left(token, length(token) - 1) ELSE token END AS stem FROM tok GROUP BY token),
idf AS (SELECT token, max(df) OVER (PARTITION BY stem) AS df, ln(n / max(df) OVER (PARTITION BY stem)) / ln(n) AS weight FROM df, every)"""


@query("a18_token_idf", f"WITH {_IDF} SELECT token, df, round(weight, 6) AS weight FROM idf")
def a18_token_idf(spark, sf_dir):
    return N.token_weights(_taxonomy(spark, sf_dir)).select("token", "df", F.round("weight", 6).alias("weight"))


def _search_sql(q):
    slug, words = q.replace(" ", "_"), ", ".join(f"'{w}'" for w in sorted(set(q.split())))
    return f"""WITH {_IDF}, cov AS (SELECT slug, 2e-1 + 35e-2 * sum(weight) / (SELECT sum(weight) FROM idf WHERE token IN ({words})) AS c
      FROM tok JOIN idf USING (token) WHERE token IN ({words}) GROUP BY slug HAVING max(weight) >= 5e-1),
    d AS (SELECT slug, CASE WHEN slug = '{slug}' THEN 1e0 WHEN starts_with(slug, '{slug}') THEN 9e-1 WHEN contains(slug, '{slug}') THEN 75e-2 WHEN list_contains(path, '{slug}') THEN 6e-1 END AS t FROM tax)
    SELECT slug, round(coalesce(t, c), 3) AS confidence FROM d LEFT JOIN cov USING (slug) WHERE coalesce(t, c) IS NOT NULL"""


@query("e15_category_search", _search_sql("ring"))
def e15_category_search(spark, sf_dir):
    return N.search_categories(_taxonomy(spark, sf_dir), "ring")


@query("e15_category_coverage", _search_sql("bolt of small ring"))
def e15_category_coverage(spark, sf_dir):
    return N.search_categories(_taxonomy(spark, sf_dir), "bolt of small ring")


@query("a17_taxonomy_roots", f"WITH {_TAX_SQL} SELECT path[1] AS root, count(*) AS n FROM tax GROUP BY 1")
def a17_taxonomy_roots(spark, sf_dir):
    return _taxonomy(spark, sf_dir).groupBy(F.col("path")[0].alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a04_address_dedup",
    f"""WITH {ADDRESSES_SQL} SELECT number, street, postcode, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit, count(*) AS n,
    round(min({sql_from_centre()}), 1) AS distance FROM addresses GROUP BY number, street, postcode""",
)
def a04_address_dedup(spark, sf_dir):
    df = G.addresses(spark, sf_dir).withColumn("distance", haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")))
    return N.dedup_addresses(df).select("number", "street", "postcode", "unit", "n", F.round("distance", 1).alias("distance"))


@query(
    "a05_postcode_centroid",
    f"WITH {ADDRESSES_SQL} SELECT country, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM addresses WHERE upper(trim(postcode)) IN ('00007', '00 007', '00013') GROUP BY country ORDER BY n DESC, country LIMIT 10",
)
def a05_postcode_centroid(spark, sf_dir):
    found = N.postcode_centroids(G.addresses(spark, sf_dir), ["00007", "00 007", "00013"])
    return found.select("country", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_DIFF = f"""WITH {PLACES_SQL}, a AS (SELECT id, name, category, confidence FROM places WHERE id % 10 <> 0),
b AS (SELECT id, CASE WHEN id % 7 = 0 THEN name || ' II' ELSE name END AS name, category, confidence FROM places WHERE id % 10 <> 1),
d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'appeared' WHEN b.id IS NULL THEN 'disappeared'
  WHEN a.name IS DISTINCT FROM b.name OR a.category IS DISTINCT FROM b.category THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN b.id IS NULL THEN a.name ELSE b.name END AS name, coalesce(b.category, a.category) AS category, coalesce(b.confidence, a.confidence) AS confidence
  FROM a FULL OUTER JOIN b ON a.id = b.id)"""


@query("j09_release_diff", f"{_DIFF} SELECT id, change, name FROM d")
def j09_release_diff(spark, sf_dir):
    return C.diff(*G.releases(spark, sf_dir)).select("id", "change", "name")


@query("a14_diff_counts", f"{_DIFF} SELECT change, count(*) AS n FROM d GROUP BY change")
def a14_diff_counts(spark, sf_dir):
    return C.counts(C.diff(*G.releases(spark, sf_dir)))


@query(
    "a13_diff_breakdown",
    f"""{_DIFF}, c AS (SELECT change, coalesce(category, 'uncategorized') AS category, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT change, category, n, CAST(row_number() OVER (PARTITION BY change ORDER BY n DESC, category) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""",
)
def a13_diff_breakdown(spark, sf_dir):
    return C.breakdown(C.diff(*G.releases(spark, sf_dir)))


@query(
    "t16_changes_digest",
    f"""{_DIFF} SELECT change, id, CAST(row_number() OVER (PARTITION BY change ORDER BY coalesce(confidence, -1e0) DESC, name NULLS LAST, id) AS INTEGER) AS rank
    FROM d WHERE change <> 'unchanged' QUALIFY rank <= 8""",
)
def t16_changes_digest(spark, sf_dir):
    return C.digest(C.diff(*G.releases(spark, sf_dir))).select("change", "id", "rank")
