"""Quantities recorded in different units (problem 1).

1. *Stated units*: `read_unit` reads a unit from a label; `stated_in` finds the unit that a text says its figures
   are presented in. The label prevails, the texts come next.
2. *Changepoints*: the history of each source, field and currency is cut by an exact search for the segmentation with
   the least weighted squared error of log10 values plus a penalty per segment (optimal partitioning with pruning).
   A shift of level between segments that matches a known factor marks a change of unit. A segment without a stated unit
   takes the one that best brings it to the level of the source: that of its stated segments once converted, with the
   currency's level counting as `PRIOR` of its figures, and units weighed by how often the currency is stated in them.
3. *Conversion*: figure times unit, as whole units of the figure's own currency. `basis` tells where the unit comes
   from: `label`, `text`, `label_history` (a label that names a unit we can't read, scaled by its segment) or
   `history` (no unit stated at all, scaled by its segment).

Histories are pre-aggregated to one point per period and unit before any grouping, so a source that holds a third of
all rows costs as many points as it has periods.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingweave.session import cut

PENALTY = 0.5
TOLERANCE = 0.75
SALTS = 8
PRIOR = 2.0
SPREAD = 0.8  # decades that the converted figures of a source spread over
KNOWN_SHIFTS = (2, 3, 4, 5, 6, 7, 8, 9, 12)
KNOWN_UNITS = (-2, 0, 3, 4, 5, 6, 7, 8, 9, 12)

# Number words of unit labels and their powers of ten.
POWERS = {
    "hundred": 2, "thousand": 3, "thousands": 3, "thou": 3, "thsd": 3, "ribu": 3, "ribuan": 3, "wan": 4, "lakh": 5, "lakhs": 5, "lac": 5,
    "lacs": 5, "million": 6, "millions": 6, "mil": 6, "mill": 6, "mio": 6, "mln": 6, "mn": 6, "mm": 6, "juta": 6, "jutaan": 6, "msek": 6,
    "crore": 7, "crores": 7, "cr": 7, "oku": 8, "billion": 9, "billions": 9, "bil": 9, "bn": 9, "bln": 9, "miliar": 9, "milyar": 9,
    "trillion": 12, "trillions": 12, "trn": 12, "triliun": 12, "tn": 12,
}
HAN = {"十億": 9, "十亿": 9, "百万": 6, "百萬": 6, "千万": 7, "兆": 12, "億": 8, "亿": 8, "万": 4, "萬": 4, "千": 3, "元": 0, "円": 0, "令吉": 0, "仙": -2}
CENTS = {"sen", "cent", "cents"}
WHOLE = {"whole", "full", "penuh", "actual", "units", "unit", "absolute"}
CURRENCIES = {
    "rm", "myr", "ringgit", "usd", "us", "dollar", "dollars", "sgd", "jpy", "yen", "yuan", "rmb", "cny", "inr", "rs", "rupee", "rupees",
    "idr", "rp", "rupiah", "sek", "krona", "kronor", "eur", "euro", "euros", "gbp", "pound", "pounds", "hkd", "thb", "baht", "aud", "malaysia",
}
_CODES = r"(?:rm|myr|us\$|s\$|a\$|hk\$|\$|usd|sgd|jpy|inr|idr|sek|cny|rmb|eur|gbp|€|£|¥)"
_GLUED = re.compile(rf"{_CODES}\s*'?\s*(k|m|b)\b")
_THOUSAND = re.compile(r"'\s*000s?\b|(?<![\d.,])000s?\b|(?<=[a-z$])000s?\b")
_GLUED_POWER = {"k": 3, "m": 6, "b": 9}
_NOISE = re.compile(r"\b(?:unless (?:otherwise )?(?:stated|indicated)(?: otherwise)?|unit of presentation|unit|units? of)\b\s*:?")
_WORDS = re.compile(r"[a-z]+")
_LONG = sorted(w for w in POWERS if len(w) >= 4)


def _near(a: str, b: str) -> bool:
    """One slip apart: an insertion, a deletion, a replacement or a swap of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@lru_cache(maxsize=1 << 16)
def read_unit(label: str | None) -> int | None:
    """The power of ten of a unit label, 0 for whole units, -2 for sen or cents, None where it names no unit."""
    if not label:
        return None
    text = re.sub(r"\s+", " ", label.lower().replace("’", "'").replace("‘", "'").replace("`", "'")).strip()
    text = re.sub(r"(?<=['\sa-z$])o{3}s?\b", "000", text) if re.search(r"ooo", text) else text
    text = _NOISE.sub(" ", text)
    words = _WORDS.findall(text)
    if any(w in WHOLE for w in words) and any(w in CURRENCIES for w in words) or re.search(r"\bwithout rounding\b", text):
        return 0
    if re.search(r"(?<!\d)10,000(?!\d)|\bten thousand\b", text):
        return 4
    if re.search(r"(?<!\d)100 million\b|\bhundreds? (?:of )?millions?\b", text):
        return 8
    for han, power in HAN.items():
        if han in text:
            return power
    named = [POWERS[w] for w in words if w in POWERS]
    if not named:
        named = [POWERS[x] for w in words if len(w) >= 5 and w not in CURRENCIES for x in _LONG if x[0] == w[0] and _near(w, x)][:1]
    if named:
        return named[0]
    if _THOUSAND.search(text):
        return 3
    glued = _GLUED.search(text)
    if glued:
        return _GLUED_POWER[glued[1]]
    if any(w in CENTS for w in words):
        return -2
    if any(w in CURRENCIES for w in words) or re.search(r"[$€£¥]", text):
        return 0
    return None


_SPLITS = [
    re.compile(r"^\s*revenue\s*:?\s*(?P<revenue>.*?)\s*[/;,]\s*(?:pbt|profit before tax)\s*:?\s*(?P<pbt>.*)$", re.I),
    re.compile(r"^\s*(?:pbt|profit before tax)\s*:?\s*(?P<pbt>.*?)\s*[/;,]\s*revenue\s*:?\s*(?P<revenue>.*)$", re.I),
    re.compile(r"^(?P<revenue>.*?)\s*\((?:pbt|profit before tax)\s+(?:is |are )?in\s+(?P<pbt>.*)\)\s*$", re.I),
    re.compile(r"^(?P<pbt>.*?)\s*\(revenue\s+(?:is |are )?in\s+(?P<revenue>.*)\)\s*$", re.I),
]


def field_labels(label: str | None) -> dict[str, str | None]:
    """The label of each field; one label may give each field its own unit."""
    for pattern in _SPLITS:
        m = pattern.match(label or "")
        if m:
            return m.groupdict()
    return {"revenue": label, "pbt": label}


NOTHING = re.compile(r"^\s*(?:as (?:reported|stated|shown)|see (?:header|note|notes|below|above)|n\.?/?a\.?|none|nil|null|unknown|not stated|various|mixed|tba|-+|\?+)?\s*$", re.I)
_STATED = re.compile(
    r"\((?:expressed |stated |presented |figures |all figures |amounts )?in (?P<a>[^()]*(?:\([^()]*\)[^()]*)?)\)"
    r"|\b(?:figures|amounts|tables|statements|sums|numbers|accounts)\b[^.;:\d]{0,60}?\b(?:presented|prepared|stated|expressed|shown|reported|rounded|given)\s+(?:are\s+)?(?:in|as|to)\s+(?:the nearest\s+)?(?P<b>[^.;\n]*)"
    r"|\b(?:figures|amounts|numbers)\s+(?:shown|stated|presented|given)?\s*(?:are|is)\s+(?:in\s+)?(?P<c>[^.;\n]*)"
    r"|\bunits?(?: of presentation| of account)?\s*[:：]\s*(?P<d>[^.;\n]*)"
    r"|(?:单位|單位)\s*[:：]\s*(?P<e>[^。；\n]*)",
    re.I,
)


def stated_in(text: str | None) -> int | None:
    """The unit a text says the report's figures are presented in; sums merely quoted in it don't count."""
    for m in _STATED.finditer(text or ""):
        part = next((g for g in m.groups() if g is not None), "")
        if re.search(r"\d", part.replace("000", "").replace("10,000", "").replace("100 million", "")):
            continue
        power = read_unit(part)
        if power is not None:
            return power
    return None


def segments(values: np.ndarray, weights: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Segment numbers of the exact least of weighted squared error plus penalty per segment.

    Optimal partitioning with pruning: a start is dropped once it can't be best for any later end, so the result
    is the exact optimum.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=int)
    w = np.concatenate([[0.0], np.cumsum(weights)])
    s = np.concatenate([[0.0], np.cumsum(weights * values)])
    q = np.concatenate([[0.0], np.cumsum(weights * values * values)])
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, dtype=int)
    starts = np.array([0])
    for end in range(1, n + 1):
        dw, ds = w[end] - w[starts], s[end] - s[starts]
        cost = best[starts] + (q[end] - q[starts]) - ds * ds / dw
        at = int(np.argmin(cost))
        best[end], back[end] = cost[at] + penalty, starts[at]
        starts = np.append(starts[cost <= best[end]], end)
    out = np.zeros(n, dtype=int)
    end, cuts = n, []
    while end > 0:
        cuts.append(int(back[end]))
        end = int(back[end])
    for number, start in enumerate(reversed(cuts)):
        out[start:] = number
    return out


def snap(shift: float, tolerance: float = TOLERANCE) -> int | None:
    """The known factor (as a signed power of ten) that a shift of level matches, 0 for none needed."""
    if abs(shift) <= tolerance:
        return 0
    near = min(KNOWN_SHIFTS, key=lambda k: abs(abs(shift) - k))
    return int(math.copysign(near, shift)) if abs(abs(shift) - near) <= tolerance else None


POINT_KEY = ["source", "field_name", "currency", "period", "stated"]
SEGMENTED = "source string, field_name string, currency string, period long, stated int, segment int, level double, unit_change int, implied int"


Point = tuple[int | None, int | None, int, float]


def likeliest(level: float, home: float, stated: dict[int, int], told: dict[int, int]) -> int:
    """The unit (power of ten) that best brings printed figures of a level to a converted one; stated: how often the
    currency's figures are stated in each, told: how often those of the segment are."""
    total = sum(stated.values()) + 0.5 * len(KNOWN_UNITS)
    often = lambda u: PRIOR * (stated.get(u, 0) + 0.5) / total + told.get(u, 0)
    fit = lambda u: math.log(often(u)) - ((home - level - u) / SPREAD) ** 2 / 2
    return max(KNOWN_UNITS, key=lambda u: (fit(u), -abs(u)))


def place_points(points: list[Point], penalty: float = PENALTY, usual: float | None = None, stated_in_all: dict[int, int] | None = None) -> list[tuple]:
    """The points of one history (period, stated unit, n, sum of logs; in order) with segment, level, unit_change at a
    segment's first point, and the unit its segment implies. usual: the level of the currency's converted figures."""
    n = np.array([p[2] for p in points], dtype=float)
    values = np.array([p[3] for p in points]) / n
    number = segments(values, n, penalty)
    count = int(number[-1]) + 1
    weights = np.bincount(number, n, count)
    level = (np.bincount(number, values * n, count) / weights).tolist()
    told: list[Counter] = [Counter() for _ in range(count)]
    home, weight = (usual or 0.0) * PRIOR, PRIOR if usual is not None else 0.0
    for k, value, (_, stated, size, _) in zip(number, values.tolist(), points, strict=True):
        if stated is not None:
            told[k][stated] += size
            home, weight = home + size * (value + stated), weight + size
    implied = [likeliest(level[k], home / weight, stated_in_all or {}, told[k]) if weight else None for k in range(count)]
    out, last = [], -1
    for k, (period, stated, _, _) in zip(number.tolist(), points, strict=True):
        change = snap(level[k] - level[k - 1]) if k != last and k else None
        out.append((period, stated, k, level[k], change, implied[k]))
        last = k
    return out


READ = "id long, source string, currency string, period long, field_name string, figure double, stated int, basis string"


def read_rows(reports: DataFrame) -> DataFrame:
    """One row per report and field with a figure: its stated unit (power of ten or null) and where it is stated."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, source, currency, period, label, title, first, second, revenue, pbt in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                labels, text, read = field_labels(label), None, False
                for field, figure in (("revenue", revenue), ("pbt", pbt)):
                    if figure is None or not math.isfinite(figure):
                        continue
                    stated, basis = read_unit(labels[field]), "label"
                    if stated is None:
                        if not read:
                            text, read = next((p for p in map(stated_in, (title, first, second)) if p is not None), None), True
                        stated = text
                        basis = "text" if text is not None else "history" if NOTHING.match(labels[field] or "") else "label_history"
                    rows.append((number, source, currency, period, f"{field}_current", figure, stated, basis))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    quarter = F.regexp_extract(F.coalesce("fiscal_quarter", F.lit("")), "([1-4])", 1).try_cast("long")
    currency = F.upper(F.trim(F.coalesce(F.col("currency").cast("string") if "currency" in reports.columns else F.lit(""), F.lit(""))))
    return reports.select(
        F.col("id").cast("long").alias("id"),
        F.regexp_replace(F.upper(F.coalesce("company_name", F.lit(""))), "[^\\p{L}\\p{N}]+", " ").alias("source"),
        F.when(currency == "RM", "MYR").otherwise(currency).alias("currency"),
        (F.col("fiscal_year").cast("long") * 4 + F.coalesce(quarter, F.lit(1)) - 1).alias("period"),
        "unit_raw",
        "title",
        "management_commentary",
        "outlook_summary",
        F.col("revenue_current").cast("double").alias("revenue_current"),
        F.col("pbt_current").cast("double").alias("pbt_current"),
    ).mapInArrow(scan, READ)


def stated_levels(read: DataFrame) -> DataFrame:
    """field_name, currency, usual (mean log10 of the converted figures whose unit is stated), units, counts: how often
    each unit is stated. One row per field and currency."""
    each = read.where("figure <> 0 and stated is not null").groupBy("field_name", "currency", "stated").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log10(F.abs("figure")) + F.col("stated")).alias("logs"))
    return each.groupBy("field_name", "currency").agg((F.sum("logs") / F.sum("n")).alias("usual"), F.map_from_entries(F.collect_list(F.struct("stated", "n"))).alias("units"))


def segmented_histories(read: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """The points of each source's history (one per period and stated unit) with their segments.

    Histories are read one after the other from sorted partitions; one holds as many points as it has periods and
    units.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, level, out = None, [], (None, None), []
        for batch in batches:
            for source, field, currency, *point, usual, units in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if (source, field, currency) != at:
                    out += [(*at, *p) for p in place_points(points, penalty, *level)] if points else []
                    at, points, level = (source, field, currency), [], (usual, dict(units or ()))
                points.append(tuple(point))
            yield from _arrow(out)
            out = []
        if points:
            yield from _arrow([(*at, *p) for p in place_points(points, penalty, *level)])

    points = read.where("figure <> 0").groupBy(*POINT_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log10(F.abs("figure"))).alias("log_sum"))
    return (
        points.join(stated_levels(read), ["field_name", "currency"], "left")
        .select(*POINT_KEY, "n", "log_sum", "usual", "units")
        .repartition("source", "field_name", "currency")
        .sortWithinPartitions("source", "field_name", "currency", F.asc_nulls_first("period"), F.asc_nulls_last("stated"))
        .mapInArrow(scan, SEGMENTED)
    )


def _arrow(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SEGMENTED.split(", ")])


def whole_units(figure: Column, power: Column) -> Column:
    """figure * 10^power as an integer, halves to even; null without a power and beyond 63 bits. Figures count to 11
    decimals, from 10^12 on to 5, which is as far as a double's digits go there."""
    factor = F.when(power >= 0, F.pow(F.lit(10.0), power)).otherwise(1).cast("decimal(13,0)")
    cents = F.when(power < 0, F.pow(F.lit(10.0), -power)).otherwise(1).cast("decimal(3,0)")
    whole = lambda kind: F.bround(F.try_multiply(figure.try_cast(kind), factor) / cents).try_cast("long")
    return F.when(power.isNull(), None).when(F.abs(figure) < 1e12, whole("decimal(25,12)")).otherwise(whole("decimal(25,5)"))


def convert(reports: DataFrame, penalty: float = PENALTY, salts: int = SALTS) -> DataFrame:
    """Every figure with its unit and amount: id, field_name, figure, power, basis, segment, implied, amount.

    Needs id, company_name, fiscal_year, fiscal_quarter, unit_raw, title, management_commentary, outlook_summary,
    revenue_current, pbt_current, and currency if it is there. Defined cases: null, NaN and infinite figures give no row; zero figures are no
    point of a history (their segment is null); repeated rows give one row; a source without a name is the source
    ''; a null year is a period of its own, ordered first; a figure without any unit has amount null, as has one
    beyond 63 bits.
    """
    read = cut(read_rows(reports).distinct())
    places = segmented_histories(read, penalty)
    salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnsRenamed({c: f"p_{c}" for c in POINT_KEY})
    rows = read.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in POINT_KEY]
    joined = rows.join(salted.withColumnRenamed("salt", "p_salt"), [*same, F.col("salt") == F.col("p_salt"), F.col("figure") != 0], "left")
    power = F.coalesce("stated", "implied")
    return joined.select("id", "field_name", "figure", power.alias("power"), "basis", "segment", "implied", whole_units(F.col("figure"), power).alias("amount"))


def unit_changes(reports: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """The level shifts of each history that match a known factor: where a unit changed, and by what."""
    places = segmented_histories(read_rows(reports).distinct(), penalty)
    return places.where("unit_change <> 0").select("source", "field_name", "currency", "period", "segment", F.round("level", 6).alias("level"), "unit_change", "stated", "implied")


def held_out(reports: DataFrame, share: int = 5, penalty: float = PENALTY) -> DataFrame:
    """How well the segments imply a unit where none is stated: the stated units of every `share`-th row (by a hash of
    its id) are hidden, and what the segments then imply is compared with them. One row per field: hidden, implied, right."""
    read = cut(read_rows(reports).distinct())
    hidden = (F.pmod(F.xxhash64("id", F.lit(share)), F.lit(share)) == 0) & F.col("stated").isNotNull()
    shown = cut(read.withColumn("truth", F.when(hidden, F.col("stated"))).withColumn("stated", F.when(~hidden, F.col("stated"))))
    places = segmented_histories(shown.drop("truth"), penalty).withColumnsRenamed({c: f"p_{c}" for c in POINT_KEY})
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in POINT_KEY]
    judged = shown.where("truth is not null and figure <> 0").join(places, same, "left")
    return judged.groupBy("field_name").agg(F.count(F.lit(1)).alias("hidden"), F.count("implied").alias("implied"), F.count_if(F.col("implied") == F.col("truth")).alias("right"))
