import random
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingweave.operators import units as u


@pytest.mark.parametrize(
    ("label", "power"),
    [("RM'000", 3), ("RM’000", 3), ("RM'OOO", 3), ("RMk", 3), ("RM thosands", 3), ("ribu RM", 3), ("千令吉", 3), ("RM000 unless stated otherwise", 3), ("Unit: RM juta", 6), ("RM milion", 6), ("RMm", 6),
     ("SEK m", 6), ("US$ mm", 6), ("百万円", 6), ("十億円", 9), ("億円", 8), ("¥ 100 million", 8), ("hundreds of millions of yen", 8), ("RMB 10,000", 4), ("万元", 4), ("units of ten thousand yuan", 4),
     ("Rs. in Lacs", 5), ("INR cr", 7), ("Rp triliun", 12), ("miliar rupiah", 9), ("ringgit penuh", 0), ("full ringgit, without rounding to thousands", 0), ("RM (full figures)", 0), ("MYR", 0), ("US$", 0),
     ("in sen", -2), ("as reported", None), ("", None), (None, None), ("see header", None), ("n/a", None)],
)
def test_read_unit(label, power):
    assert u.read_unit(label) == power


def test_labels_of_fields():
    assert u.field_labels("revenue RM’000 / PBT RM mn") == {"revenue": "RM’000", "pbt": "RM mn"}
    assert u.field_labels("Revenue: RM; PBT: juta ringgit") == {"revenue": "RM", "pbt": "juta ringgit"}
    assert u.field_labels("RM (ribu) (profit before tax in millions)") == {"revenue": "RM (ribu)", "pbt": "millions"}


def test_stated_in_texts():
    assert u.stated_in("X Berhad Q3 FY2025 results (in RM billion)") == 9
    assert u.stated_in("Sales rose. The tables are prepared in RM ribu. Goodwill amounted to US$767.76 million.") == 3
    assert u.stated_in("(expressed in full ringgit, without rounding to thousands) Sales fell.") == 0
    assert u.stated_in("Unit of presentation: thousands of Singapore dollars.") == 3
    assert u.stated_in("Total goodwill amounted to RM289.2 million, of which RM1 million was secured in sen.") is None
    assert u.stated_in(None) is None


def brute(values, weights, penalty):
    best = {0: (-penalty, [])}
    for end in range(1, len(values) + 1):
        options = []
        for start in range(end):
            v, w = values[start:end], weights[start:end]
            m = (v * w).sum() / w.sum()
            options.append((best[start][0] + (w * (v - m) ** 2).sum() + penalty, [*best[start][1], start]))
        best[end] = min(options, key=lambda o: o[0])
    return best[len(values)][0]


@given(st.lists(st.tuples(st.floats(0, 12), st.integers(1, 5)), min_size=1, max_size=9), st.floats(0.05, 3))
@settings(max_examples=60, deadline=None)
def test_segments_are_optimal(points, penalty):
    values, weights = np.array([p[0] for p in points]), np.array([float(p[1]) for p in points])
    number = u.segments(values, weights, penalty)
    cost = -penalty
    for k in set(number.tolist()):
        v, w = values[number == k], weights[number == k]
        cost += (w * (v - (v * w).sum() / w.sum()) ** 2).sum() + penalty
    assert cost == pytest.approx(brute(values, weights, penalty), abs=1e-6)
    assert (np.diff(number) >= 0).all()


REPORT = "id long, company_name string, fiscal_year int, fiscal_quarter string, unit_raw string, title string, management_commentary string, outlook_summary string, revenue_current double, pbt_current double, source string, period string, segment int"


def reports(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], REPORT)


def test_convert(spark):
    rows = [
        (1, "A", 2023, "Q1", "RM'000", None, None, None, 1000.0, None),
        (2, "A", 2023, "Q2", "RM'000", None, None, None, 1100.0, -90.5),
        (2, "A", 2023, "Q2", "RM'000", None, None, None, 1100.0, -90.5),
        (3, "A", 2023, "Q3", "as reported", None, None, None, 1.2, 0.0),
        (4, "A", 2023, "Q4", None, "results (in RM million)", None, None, 1.1, None),
        (5, "A", 2024, "Q1", "quux", None, None, None, 1_150_000.0, None),
        (6, None, None, None, None, None, None, None, float("nan"), None),
        (7, "", None, "Qx", "in sen", None, None, None, 250.0, 1e300),
    ]
    got = {(r.id, r.field_name): (r.power, r.basis, r.amount) for r in u.convert(reports(spark, rows)).collect()}
    assert got == {
        (1, "revenue_current"): (3, "label", 1_000_000),
        (2, "revenue_current"): (3, "label", 1_100_000),
        (2, "pbt_current"): (3, "label", -90_500),
        (3, "revenue_current"): (6, "history", 1_200_000),
        (3, "pbt_current"): (None, "history", None),
        (4, "revenue_current"): (6, "text", 1_100_000),
        (5, "revenue_current"): (0, "label_history", 1_150_000),
        (7, "revenue_current"): (-2, "label", 2),
        (7, "pbt_current"): (-2, "label", None),
    }


def test_empty_and_unit_changes(spark):
    assert u.convert(reports(spark, [])).count() == 0
    rows = [(i, "A", 2020 + i // 4, f"Q{i % 4 + 1}", "RM" if i < 6 else "RM'000", None, None, None, (1e6 if i < 6 else 1e3) * (1 + i / 50), None) for i in range(12)]
    changes = u.unit_changes(reports(spark, rows)).collect()
    assert [(c.period, c.unit_change) for c in changes] == [(2021 * 4 + 2, -3)]


def test_whole_units_are_exact(spark):
    rng = random.Random(6)
    figures = [0.0, 0.5, 1.5, 2.5, -0.5, 1e300, 9.3e18, 123.45, -16.28, 4.35, 1.005, 182.98] + [round(rng.uniform(-1, 1) * 10 ** rng.randint(0, 14), rng.randint(0, 4)) for _ in range(400)]
    rows = [(i, f, p) for i, f in enumerate(figures) for p in (-2, 0, 3, 4, 5, 6, 7, 8, 9, 12)] + [(-1, 5.0, None)]
    frame = spark.createDataFrame(rows, "id long, figure double, power int")
    got = {(r.id, r.power): r.amount for r in frame.select("id", "power", u.whole_units(F.col("figure"), F.col("power")).alias("amount")).collect()}
    for i, figure, power in rows:
        want = None if power is None else int((Decimal(repr(figure)) * Decimal(10) ** power).to_integral_value(ROUND_HALF_EVEN))
        assert got[i, power] == (want if want is not None and abs(want) < 2**63 else None), (figure, power)


def test_planted_unit_changes_are_found_and_reversed(spark):
    """Steady sources that change their unit now and then: the changes are told, and hidden units are implied."""
    rng = random.Random(8)
    names = {0: "RM", 3: "RM'000", 6: "RM million"}
    rows, planted = [], set()
    for s in range(30):
        unit, level = rng.choice([0, 3, 6]), rng.uniform(7, 8)
        for q in range(40):
            if q and rng.random() < 0.1:
                new = rng.choice([x for x in names if x != unit])
                planted.add((f"S{s}", 2010 * 4 + q, unit - new))
                unit = new
            rows.append((s * 100 + q, f"S{s}", 2010 + q // 4, f"Q{q % 4 + 1}", names[unit], None, None, None, 10 ** (level - unit + rng.gauss(0, 0.05)), None))
    found = {(r.source, r.period, r.unit_change) for r in u.unit_changes(reports(spark, rows)).collect()}
    assert found == planted
    told = u.held_out(reports(spark, rows)).collect()
    assert len(told) == 1 and told[0].hidden > 200 and told[0].right >= 0.99 * told[0].hidden
