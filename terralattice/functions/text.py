"""Name and address text: folding, tiers, tokens, variants, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that no name is searched by, and bounds on the words of a query; fixed values.
STOPWORDS = ("the", "a", "an", "on", "in", "at", "near", "of", "and", "by")
MIN_TOKEN, MAX_TOKENS = 3, 12
FUZZY_THRESHOLD = 0.92

# Letters without a canonical decomposition, and what they fold to; fixed values.
EXTENDED = {"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ħ": "h", "ı": "i"}


def _decomposed() -> tuple[str, str]:
    """Characters of any script that are a base character with marks, and these bases."""
    pairs = []
    for point in range(0xC0, 0x20000):
        form = unicodedata.normalize("NFD", chr(point))
        if form[0] != chr(point) and all(unicodedata.category(c) == "Mn" for c in form[1:]):
            pairs.append((chr(point), form[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _decomposed()


def fold(c: Column) -> Column:
    """Lower case without accents, for every script, inside the JVM."""
    return F.lower(F.translate(F.regexp_replace(c, r"[\p{Mn}\p{Me}]", ""), _ACCENTED, _PLAIN))


def fold_extended(c: Column) -> Column:
    out = fold(c)
    for letter, plain in EXTENDED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


@F.pandas_udf(T.StringType())
def fold_exact(values: pd.Series) -> pd.Series:
    """Any script: canonical decomposition, marks dropped, lower case."""

    def one(text):
        if text is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn").lower()

    return values.map(one)


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c: Column, needle: str) -> Column:
    return F.lower(c).contains(needle.lower())


def starts_ci(c: Column, prefix: str) -> Column:
    return F.lower(c).startswith(prefix.lower())


def match_tier(name: Column, query: Column) -> Column:
    """3 exact, 2 prefix, 1 substring, 0 none, on folded strings."""
    n, q = fold(name), fold(query)
    return F.when(n == q, 3).when(n.startswith(q), 2).when(n.contains(q), 1).otherwise(0)


def tokens(c: Column) -> Column:
    """Words of three letters or more that are no stop words, twelve at most; with stop words if none is left, else the whole text."""
    long = F.filter(F.regexp_extract_all(c, F.lit(r"(?U)([\w'-]+)"), F.lit(1)), lambda w: F.length(w) >= MIN_TOKEN)
    kept = F.filter(long, lambda w: ~F.lower(w).isin(*STOPWORDS))
    return F.slice(F.when(F.size(kept) > 0, kept).when(F.size(long) > 0, long).otherwise(F.array(c)), 1, MAX_TOKENS)


def stem(c: Column) -> Column:
    return F.when((F.length(c) > 3) & c.endswith("s"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def has_phrase(text: Column, phrase: str) -> Column:
    """A whole-word phrase of letters."""
    import re

    return F.lower(text).rlike(rf"(?<![a-z]){re.escape(phrase.lower())}(?![a-z])")


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    theirs = [ch for ch, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(hits, theirs)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str | None, b: str | None) -> float | None:
    """Prefix bonus of 0.1 for up to four letters, above a similarity of 0.7."""
    if a is None or b is None:
        return None
    score = _jaro(a, b)
    if score <= 0.7:
        return score
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + prefix * 0.1 * (1 - score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    memo: dict = {}

    def one(a, b):
        if (a, b) not in memo:
            memo[a, b] = jaro_winkler_of(a, b)
        return memo[a, b]

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")


def window_similarity(name: Column, query: Column) -> Column:
    """The better of the whole name and its beginning as long as the query."""
    return F.greatest(jaro_winkler(name, query), jaro_winkler(F.substr(name, F.lit(1), F.length(query)), query))


# Two-letter codes of the states for region suffixes; fixed values.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}


def _table(pairs: dict) -> Column:
    """A map literal of names to a text, or to a list of texts."""
    value = lambda v: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v))
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), value(v))))


def state_of(c: Column) -> Column:
    """The code of a state named by its code or in full, null if it is none; a final full stop does no harm."""
    t = F.regexp_replace(F.trim(c), r"\.+$", "")
    by_name = _table({name.lower(): code for code, name in STATES.items()})
    return F.coalesce(F.when(F.upper(t).isin(*STATES), F.upper(t)), F.try_element_at(by_name, F.lower(t)))


def region_suffix(c: Column) -> tuple[Column, Column]:
    """(name, state code): what follows the last comma, else the last word, if it names a state; the text itself and null if neither does."""
    t = F.trim(c)
    before, after = F.trim(F.regexp_extract(t, r"^(.*),", 1)), F.trim(F.regexp_extract(t, r",([^,]*)$", 1))
    head, last = F.trim(F.regexp_extract(t, r"^(.*\S)\s+\S+$", 1)), F.regexp_extract(t, r"\s(\S+)$", 1)
    by_comma = F.when((before != "") & (after != ""), state_of(after))
    by_word = F.when((head != "") & (last != ""), state_of(last))
    return F.when(by_comma.isNotNull(), before).when(by_word.isNotNull(), head).otherwise(c), F.coalesce(by_comma, by_word)


# Other spellings of a word of a name or street, in the order in which they are tried; fixed values.
NAME_FORMS = {"st": ["Saint"], "saint": ["St.", "St"], "ft": ["Fort"], "fort": ["Ft.", "Ft"], "mt": ["Mount"], "mount": ["Mt.", "Mt"]}
CARDINAL_FORMS = {
    "n": ["North"], "north": ["N.", "N"],
    "s": ["South"], "south": ["S.", "S"],
    "e": ["East"], "east": ["E.", "E"],
    "w": ["West"], "west": ["W.", "W"],
}
STREET_FORMS = {
    "street": ["St"], "st": ["Street"],
    "avenue": ["Ave"], "ave": ["Avenue"],
    "parkway": ["Pkwy"], "pkwy": ["Parkway"],
    "boulevard": ["Blvd"], "blvd": ["Boulevard"],
    "road": ["Rd"], "rd": ["Road"],
    "drive": ["Dr"], "dr": ["Drive"],
    "lane": ["Ln"], "ln": ["Lane"],
    "court": ["Ct"], "ct": ["Court"],
    "place": ["Pl"], "pl": ["Place"],
}
QUADRANT_FORMS = {
    "nw": ["Northwest"], "northwest": ["NW"],
    "ne": ["Northeast"], "northeast": ["NE"],
    "sw": ["Southwest"], "southwest": ["SW"],
    "se": ["Southeast"], "southeast": ["SE"],
}
ORDINAL_WORDS = {
    "first": ["1st", "1"], "second": ["2nd", "2"], "third": ["3rd", "3"], "fourth": ["4th", "4"], "fifth": ["5th", "5"], "sixth": ["6th", "6"],
    "seventh": ["7th", "7"], "eighth": ["8th", "8"], "ninth": ["9th", "9"], "tenth": ["10th", "10"], "eleventh": ["11th", "11"],
    "twelfth": ["12th", "12"],
}
#: Spellings of one street at most.
STREET_CAP = 24


def _merged(*tables: dict) -> dict:
    out: dict = {}
    for t in tables:
        for key, forms in t.items():
            out[key] = out.get(key, []) + forms
    return out


def _none() -> Column:
    return F.array().cast("array<string>")


def _numbered(key: Column) -> Column:
    """The other form of a numeral: 5th and 5."""
    n = key.cast("long")
    ending = F.when(F.pmod(n, F.lit(100)).between(10, 13), "th").otherwise(
        F.coalesce(F.try_element_at(_table({"1": "st", "2": "nd", "3": "rd"}), F.pmod(n, F.lit(10)).cast("string")), F.lit("th"))
    )
    bare = F.regexp_extract(key, r"^(\d+)(?:st|nd|rd|th)$", 1)
    return F.when(bare != "", F.array(bare)).when(key.rlike(r"^\d+$"), F.array(F.concat(key, ending))).otherwise(_none())


def street_variants(c: Column) -> Column:
    """The text itself and every choice of other forms of its words, in order, distinct but for case; the first 24 of the product."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    table = _table(_merged(NAME_FORMS, STREET_FORMS, QUADRANT_FORMS, ORDINAL_WORDS, CARDINAL_FORMS))
    alone = F.size(words) == 1

    def choices(word: Column) -> Column:
        key = F.lower(F.regexp_replace(word, r"^\.+|\.+$", ""))
        forms = F.concat(F.array(word), F.coalesce(F.try_element_at(table, key), _none()), _numbered(key))
        # A lone word stands for the beginnings of streets, so it never becomes a mere number.
        return F.filter(forms, lambda f: ~(alone & f.rlike(r"^\d+$") & ~word.rlike(r"^\d+$")))

    def longer(heads: Column, word: Column) -> Column:
        grown = F.flatten(F.transform(heads, lambda h: F.transform(choices(word), lambda w: F.concat_ws(" ", h, w))))
        return F.slice(grown, 1, STREET_CAP)

    every = F.aggregate(words, F.array(F.lit(None).cast("string")), longer)
    first = lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1
    return F.when(F.size(words) > 0, F.filter(every, first)).otherwise(_none())


def name_variants(c: Column) -> Column:
    """Spellings of a place's name with one word in another form, without the name itself; the first word may be a cardinal point."""
    words, table = F.split(c, " "), _table(NAME_FORMS)
    leading = _table(_merged(NAME_FORMS, CARDINAL_FORMS))
    bare = lambda w: F.lower(F.regexp_replace(w, r"^\.+|\.+$", ""))

    def swapped(word: Column, i: Column) -> Column:
        forms = F.coalesce(F.try_element_at(F.when(i == 0, leading).otherwise(table), bare(word)), _none())
        return F.transform(
            forms, lambda f: F.concat_ws(" ", F.slice(words, F.lit(1), i), f, F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0))))
        )

    every = F.flatten(F.transform(words, swapped))
    first = lambda x, i: (F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1) & (F.lower(x) != F.lower(c))
    return F.filter(every, first)


# Postcodes by the shapes of the countries that have them; fixed values.
POSTCODE_SHAPES = (
    r"^\d{4}$", r"^\d{5}$", r"^\d{6}$", r"^\d{5}-\d{4}$", r"^\d{5}-\d{3}$", r"^\d{4}-\d{3}$",
    r"^\d{4} ?[A-Z]{2}$", r"^[A-Z]\d[A-Z] ?\d[A-Z]\d$", r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$",
)


def postcode_of(c: Column) -> Column:
    """Upper case with single blanks inside."""
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def is_postcode(c: Column) -> Column:
    t, out = postcode_of(c), F.lit(False)
    for shape in POSTCODE_SHAPES:
        out = out | t.rlike(shape)
    return out


def postcode_variants(c: Column) -> Column:
    """A postcode's spellings with and without its blank, sorted; null for what has no postcode's shape.

    Letters and digits part after the fourth character in the Netherlands, before the last three elsewhere.
    """
    t = postcode_of(c)
    spaced = F.when(t.rlike(r"^\d{4}[A-Z]{2}$"), F.regexp_replace(t, r"^(....)", "$1 ")).when(
        F.length(t) >= 5, F.regexp_replace(t, r"^(.*)(...)$", "$1 $2")
    )
    other = F.when(t.contains(" "), F.replace(t, F.lit(" "))).when(t.rlike("[A-Z]"), spaced)
    return F.when(is_postcode(c), F.array_sort(F.array_distinct(F.array_compact(F.array(t, other)))))


# Words that begin streets which are numbered, and particles that make a leading number part of a street's name; fixed values.
LEADING_STREET_TYPES = (
    "calle", "avenida", "avda", "av", "carrera", "cra", "calzada", "camino",
    "paseo", "diagonal", "transversal", "autopista", "rua", "rue", "via",
    "viale", "corso", "strada", "vicolo", "travessa",
    "route", "highway", "hwy", "interstate", "us",
)
LEADING_STREET_PAIRS = (
    "county road", "county route", "county highway", "state route",
    "state road", "state highway", "historic route", "old highway",
    "farm road", "ranch road",
)
STREET_PARTICLES = ("de", "del", "di", "du", "des", "da", "do", "la", "le", "el", "of")
_HOUSE_NUMBER = r"^\d+[A-Za-z]?$"


def parse_address(c: Column) -> tuple[Column, Column, Column]:
    """(number, street, place): the first comma parts street and place.

    The number leads the street, unless a particle follows it, or trails it, unless the street begins with a word that numbers streets; it is
    never all there is.
    """
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x))
    half = F.get(parts, F.lit(0))
    place = F.array_join(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != ""), ", ")
    words = F.filter(F.split(half, r"\s+"), lambda w: w != "")
    first, second, last = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    several = F.size(words) >= 2
    numbering = F.lower(first).isin(*LEADING_STREET_TYPES) | F.lower(F.concat_ws(" ", first, second)).isin(*LEADING_STREET_PAIRS)
    leads = several & first.rlike(_HOUSE_NUMBER) & ~F.lower(second).isin(*STREET_PARTICLES)
    trails = several & last.rlike(_HOUSE_NUMBER) & ~numbering
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    street = F.when(leads, F.array_join(F.slice(words, F.lit(2), rest), " ")).when(trails, F.array_join(F.slice(words, F.lit(1), rest), " "))
    return F.when(leads, first).when(trails, last), F.coalesce(street, half), F.when(place != "", place)
