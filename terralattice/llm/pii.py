"""Personal data: exact base patterns, and candidate spans judged by gradient-boosted trees; DataFrame functions only.

Base kinds (email, ip, card, phone) are found by their patterns, leftmost and non-overlapping, and checked; they always stay.  Beside
them, high-recall generators propose spans that may overlap, of the same kinds in looser spellings and of one more, ``secret``.
Each candidate has a few small integer features of its format and context.

No person has labelled the candidates.  Their labels are weak ones, by evidence that the features do not show and the base patterns
do not ask for: an email's written-out form ends in a name of letters, an ip has four plain octets and is no version, a card's
digits pass Luhn, a phone number can be dialled, stands alone and is neither card nor ip, and a secret stands behind a word like password or token or begins as
issued keys do (its own context is no feature).  Trees are fitted on the counts of feature vectors among the candidates of all
documents; only the distinct vectors, few as features are small integers, come to the driver.  Scores of rows that a model has not
seen, from FOLDS folds of documents, are calibrated per kind by isotonic regression; a kind's threshold is the lowest score whose calibrated
probability is PRECISION.

Accepted candidates that touch no base span are added; among overlapping ones that of the kind first in PRIORITY stays, so that digits
inside a secret don't take its place.

Patterns are written so that the matcher never goes back over a run (possessive quantifiers, and starts only at a run's first
character or at the end of the match before), which finds the same matches in linear time and constant stack.  A text is searched once per
pattern: matches are marked and the marked text is split, so very long texts cost time in proportion to their length.

Null texts are empty, and empty ones have no spans; an empty table gives no rows.  Documents are judged row by row, so repeated ids and rows
have no effect.  Positions are code points.  Extra columns pass through; the results' names get more underscores if they are taken.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralattice.llm._common import column, columns, free_prefix, prepare

KINDS = ("email", "ip", "card", "phone", "secret")
PRECISION = 0.95
ROUNDS, RATE, DEPTH, FOLDS = 24, 0.3, 2, 3
CONTEXT = 24
PRIORITY = ("email", "ip", "secret", "card", "phone")
#: The columns that come after a prefix: base spans by kind, all of them, and all spans.
NAMES = (*KINDS[:4], "base", "spans")

_LOCAL = "[A-Za-z0-9._%+-]"
_BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[ -]?[0-9]){11,}+", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
_LOOSE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)*+", ""),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){2,}+", "."),
    "card": (r"[0-9](?:[ ._-]?[0-9]){11,}+", ""),
    "phone": (r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+", ""),
    "secret": (r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+", ""),
}
_KEYWORDS = r"(?i)(?:mail|contact|phone|tel|call|fax|card|visa|host|addr|server|passw|token|secret|key)[^\n]{0,12}$"
_NAMED_HOST = r"(?i)(?:@|[(\[]at[)\]]) ?[a-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[a-z0-9-]+)* ?(?:\.|[(\[]dot[)\]]) ?[a-z]{2,24}$"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_VERSION = r"(?i)(?:version|release|section|\bv)[ .]?$"
_DIALLED = r"^(?:\+|\(?[2-9][0-9]{2}\)?[ .-]{0,2}[2-9][0-9]{2}[ .-]?[0-9]{4}$)"
_ISSUED = r"^(?:AKIA|ASIA|ghp|sk|pk)[A-Z0-9a-z]"
_ASSIGNED = r"(?i)(?:passw|pwd|token|secret|auth|key)[^\n]{0,12}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            (2 * F.substr(digits, i, F.lit(1)).cast("int")) % 10
            + F.floor(2 * F.substr(digits, i, F.lit(1)).cast("int") / 10).cast("int")
        ),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(
            F.split(m, r"\."),
            lambda p: (F.length(short(p)) <= 3)
            & (F.coalesce(F.when(F.length(short(p)).between(1, 3), short(p)).cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & _luhn(F.substr(_digits(m), F.lit(1), F.lit(19)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda x: _valid(kind, x["m"])


# --- matches and their places ---------------------------------------------------------------------

_SPAN = "array<struct<s:int,e:int,m:string>>"
#: Marks of a match's begin and end: two code points that are no characters.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"
_AT_ONCE = 64


def searchable(text: Column) -> Column:
    """The text, null as empty, without the marks; every code point keeps its place."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT, "\ufffd\ufffd")


def _sums(first: Column, sizes: Column) -> Column:
    """first, first + sizes[0], first + sizes[0] + sizes[1], ..."""
    return F.aggregate(sizes, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _starts(first: Column, sizes: Column) -> Column:
    """Where each of some neighbouring stretches begins; sums run over _AT_ONCE of them at a time, and then over those."""
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _AT_ONCE).cast("int")), lambda i: F.slice(sizes, i * _AT_ONCE + 1, _AT_ONCE)
    )
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, n: acc + n)
    begin = F.slice(_sums(first, F.transform(parts, total)), F.lit(1), F.size(parts))
    return F.flatten(F.zip_with(parts, begin, lambda part, at: F.slice(_sums(at, part), F.lit(1), F.size(part))))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Start, end and text of every match in a searchable text, left to right."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN, -1)
    after = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
    begin = _starts(F.length(F.get(pieces, F.lit(0))), F.transform(after, lambda p: F.length(p) - 1))

    def span(piece: Column, at: Column) -> Column:
        found = F.substring_index(piece, _SHUT, 1)
        return F.struct(at.alias("s"), (at + F.length(found)).alias("e"), found.alias("m"))

    some = F.size(pieces) > 1
    if needs:
        some = F.contains(text, F.lit(needs)) & some
    return F.when(some, F.zip_with(after, begin, span)).otherwise(F.array().cast(_SPAN))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        kind: _tagged(F.filter(matches(text, *_BASE[kind]), _validator(kind)), i)
        for i, kind in enumerate(KINDS[:4])
    }


# --- candidates -----------------------------------------------------------------------------------

FEATURES = ("kind", "digits", "marks", "size", "before", "after", "keyword", "plus", "shape", "lead")
_LEVELS = 32


def _char_class(c: Column) -> Column:
    return (
        F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"\p{N}"), 3).otherwise(4)
    )


def _head(text: Column, s: Column) -> Column:
    return F.substr(text, F.greatest(s - CONTEXT + 1, F.lit(1)), F.least(s, F.lit(CONTEXT)))


def _shape(kind: str, m: Column) -> Column:
    flag = lambda c, weight: F.when(c, weight).otherwise(0)
    if kind == "email":
        return flag(~m.contains("@"), 1) + flag(m.contains(" "), 2)
    if kind == "ip":
        return F.least(F.size(F.split(m, r"\.")), F.lit(8))
    if kind == "secret":
        return F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike("^[0-9a-f]+$"), 1).when(m.rlike("^[A-Z0-9]+$"), 2).otherwise(3)
    return flag(m.contains(" "), 1) + flag(m.contains("-"), 2) + flag(m.rlike("[._]"), 4) + flag(m.rlike("[()]"), 8)


def _features(text: Column, x: Column, kind: int) -> Column:
    m, s, e = x["m"], x["s"], x["e"]
    name, digits = KINDS[kind], _digits(m)
    return F.array(
        F.lit(kind),
        F.least(F.length(digits), F.lit(24)),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(6)),
        F.least(F.floor(F.length(m) / 4).cast("int"), F.lit(10)),
        _char_class(F.when(s > 0, F.substr(text, s, F.lit(1))).otherwise("")),
        _char_class(F.substr(text, e + 1, F.lit(1))),
        F.lit(0) if name == "secret" else _head(text, s).rlike(_KEYWORDS).cast("int"),
        m.startswith("+").cast("int"),
        _shape(name, m),
        F.substr(digits, F.lit(1), F.lit(1)).cast("int") + 1 if name in ("card", "phone") else F.lit(0),
    )


def weak_label(text: Column, x: Column, kind: int) -> Column:
    """Whether evidence beyond the features speaks for a candidate."""
    m, head, n = x["m"], _head(text, x["s"]), F.length(_digits(x["m"]))
    name = KINDS[kind]
    if name == "email":
        return m.rlike(_NAMED_HOST)
    if name == "ip":
        return m.rlike(_OCTETS) & ~head.rlike(_VERSION)
    if name == "card":
        return _valid("card", m)
    if name == "phone":
        alone = ~head.rlike("[A-Za-z0-9]$") & ~F.substr(text, x["e"] + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        return n.between(9, 15) & m.rlike(_DIALLED) & alone & ~m.rlike(_OCTETS) & ~((n >= 13) & _valid("card", m))
    return m.rlike(_ISSUED) | head.rlike(_ASSIGNED)


def _candidate(text: Column, kind: int, label: bool):
    def of(x: Column) -> Column:
        y = [weak_label(text, x, kind).cast("long").alias("y")] if label else []
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"), *y, _features(text, x, kind).alias("f"))

    return of


def candidates(text: Column, label: bool = False) -> list[Column]:
    """By kind the candidates of a searchable text: s, e, k, features f, and the weak label y if asked for."""
    return [F.transform(matches(text, *_LOOSE[kind]), _candidate(text, i, label)) for i, kind in enumerate(KINDS)]


def _touch(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


# --- boosted trees over counted feature vectors -------------------------------------------------


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float = 1e-6):
    """A tree of (feature, cut, rows at most the cut, rows above it), or a leaf's step."""
    total_g, total_h = gradient.sum(), hessian.sum()
    worth = lambda g, h: g * g / (h + 1.0)
    gains = np.zeros((x.shape[1], _LEVELS))
    for j in range(x.shape[1] if depth else 0):
        g = np.cumsum(np.bincount(x[:, j], gradient, _LEVELS))
        h = np.cumsum(np.bincount(x[:, j], hessian, _LEVELS))
        gains[j] = worth(g, h) + worth(total_g - g, total_h - h) - worth(total_g, total_h)
    j, cut = divmod(int(gains.argmax()), _LEVELS)
    if gains[j, cut] <= least:
        return RATE * float(total_g) / (float(total_h) + 1.0)
    low = x[:, j] <= cut
    return j, cut, *(_grow(x[part], gradient[part], hessian[part], depth - 1) for part in (low, ~low))


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _leaves(low, x), _leaves(high, x))


class Trees:
    """Boosted trees, fitted on feature vectors ``x`` with ``y`` positives of ``n``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        positives, total = float(y.sum()), float(n.sum())
        self.trees, self.bias = [], math.log((positives + 0.5) / (total - positives + 0.5))
        z = np.full(len(x), self.bias)
        for _ in range(ROUNDS if 0 < positives < total else 0):
            p = 1 / (1 + np.exp(-z))
            self.trees.append(_grow(x, y - n * p, n * p * (1 - p), DEPTH))
            z += _leaves(self.trees[-1], x)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_leaves(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[tuple[float, float]]:
    """(lowest score, probability) of steps that rise with the score: pooled adjacent violators of the rates y / n."""
    steps: list[list[float]] = []
    for score in np.unique(z):
        at = z == score
        steps.append([float(score), float(y[at].sum()), float(n[at].sum())])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, positives, total = steps.pop()
            steps[-1][1] += positives
            steps[-1][2] += total
    return [(score, positives / total) for score, positives, total in steps]


class Boosted:
    """Trees fitted on all counts, and a calibrated threshold per kind; ``counts`` maps (fold, feature vector) to (positives, all)."""

    def __init__(self, counts: dict[tuple[int, tuple[int, ...]], tuple[int, int]], precision: float = PRECISION):
        keys = sorted(counts)
        fold = np.array([k[0] for k in keys], int)
        x = np.array([k[1] for k in keys], int).reshape(len(keys), len(FEATURES))
        y, n = (np.array([counts[k][i] for k in keys], float) for i in (0, 1))
        model = Trees(x, y, n)
        self.trees, self.bias, self.score_of = model.trees, model.bias, model.score
        unseen = np.zeros(len(keys))
        for f in np.unique(fold):
            test = fold == f
            unseen[test] = Trees(x[~test], y[~test], n[~test]).score(x[test])
        self.steps = {k: isotonic(*(v[x[:, 0] == k] for v in (unseen, y, n))) for k in range(len(KINDS))}
        self.thresholds = {k: min((z for z, p in steps if p >= precision), default=math.inf) - 1e-9 for k, steps in self.steps.items()}

    def score(self, f: Column) -> Column:
        def as_column(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[tree[0]] <= tree[1], as_column(tree[2])).otherwise(as_column(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + as_column(tree)
        return total

    def accepts(self, x: Column, kind: int) -> Column:
        limit = self.thresholds[kind]
        return self.score(x["f"]) >= limit if limit < math.inf else F.lit(False)


def fit(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> Boosted:
    """The model of the candidates of all ``docs``."""
    every = docs.select(column(doc_id).alias("id"), searchable(column(text)).alias("text"))
    found = every.select(
        F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold"),
        F.explode(F.concat(*candidates(F.col("text"), label=True))).alias("x"),
    )
    rows = found.groupBy("fold", "x.f").agg(F.sum("x.y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    return Boosted({(r["fold"], tuple(r["f"])): (r["y"], r["n"]) for r in rows})


def _clear_of(model: Boosted, kind: int, over: list[str]):
    """Whether the model accepts a candidate that touches no span of some columns."""

    def of(x: Column) -> Column:
        clear = model.accepts(x, kind)
        for spans in over:
            clear = clear & ~F.exists(F.col(spans), lambda b: _touch(b, x))
        return clear

    return of


def find_personal_data(
    docs: DataFrame, model: Boosted | None = None, *, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` and, after ``free_prefix(docs, NAMES)``, the columns NAMES: arrays of s, e and k, the last two by start, then kind."""
    prepare(docs.sparkSession)
    model = model or fit(docs, text=text, doc_id=doc_id)
    own = free_prefix(docs, [*NAMES, "text", "loose", *(f"more{k}" for k in range(len(KINDS)))])
    at = lambda name: F.col(f"{own}{name}")
    out = docs.withColumn(f"{own}text", searchable(column(text)))
    out = out.withColumns({f"{own}{kind}": spans for kind, spans in base_spans(at("text")).items()})
    out = out.withColumns(
        {
            f"{own}base": F.concat(*(at(kind) for kind in KINDS[:4])),
            f"{own}loose": F.array(*candidates(at("text"))),
        }
    )
    plain = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))
    kept = []
    for k in map(KINDS.index, PRIORITY):
        # A kind's candidates give way to base spans and to those kept of the kinds before it, not to those that gave way themselves.
        stays = _clear_of(model, k, [f"{own}base", *kept])
        out = out.withColumn(f"{own}more{k}", F.transform(F.filter(F.get(at("loose"), F.lit(k)), stays), plain))
        kept.append(f"{own}more{k}")
    by_start = lambda spans: F.array_sort(
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    )
    out = out.withColumn(f"{own}spans", by_start(F.concat(at("base"), *map(F.col, kept)))).withColumn(f"{own}base", by_start(at("base")))
    prefix = free_prefix(docs, NAMES)
    return out.select(*columns(docs), *(at(name).alias(f"{prefix}{name}") for name in NAMES))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, model: Boosted | None = None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; a null text stays null."""
    found = find_personal_data(docs, model, text=text, doc_id=doc_id)
    spans = F.col(f"{free_prefix(docs, NAMES)}spans")
    names, source = F.array(*map(F.lit, KINDS)), column(text)
    # A span that begins inside the one before it has nothing of its own to show; where it ends later, it goes on from there.
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                x["e"].alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.concat(F.substr(source, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.get(names, x["k"]), F.lit("]"))),
                ).alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(source, acc["at"] + 1, F.length(source))),
    )
    others = [column(c) for c in docs.columns]
    others[docs.columns.index(text)] = F.when(F.size(spans) > 0, cut).otherwise(source).alias(text)
    return found.select(*others)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS[:4]),
        F.sha2(described(F.col("_base")), 256).alias("base_sha256"),
        described(F.col("_spans")).alias("spans"),
    )
