import random

import pytest

from filingweave.llm import names as n

LIST = [("11", "Dobadon Murni Electronics Holdings Berhad", "DOBADONELEC", None), ("12", "Losete Steel Group Berhad", "LOSETE", "a.k.a. Loseco; formerly Kungmo Ginni Rubber Berhad"), ("13", "Fawinum Utama Timber Berhad", None, "not polled"), ("14", "Fawinum Delta Foods (M) Berhad", None, None)]


def linked(spark, typed, entities=LIST, others=None, **more):
    t = spark.createDataFrame([(i, x, "x") for i, x in enumerate(typed)], "row_id long, company string, stock_code string")
    e = spark.createDataFrame(entities, "stock_code string, name string, short_name string, notes string")
    o = spark.createDataFrame([(x,) for x in others], "name string") if others else None
    got = {r.row_id: r.stock_code for r in n.link(t, e, o, **more).collect()}
    return [got.get(i) for i in range(len(typed))]


SPELLINGS = {
    "11": ["Dobadon Murni Electronics Holdings Berhad", "BHD, DOBADON MURNI ELECTRNCS", "dobadon elec hldgs bhd", "D.M.E.H.B.", "dmehb", "DOBADON  MURNI ELECCTRONICS", "Dobad on Murni Elektronik", "DobadonMurni Electronics", "<b>DOBADONELEC</b>.KL", "Dobadon Holdings [NS]", "ＤＯＢＡＤＯＮ ＭＵＲＮＩ", "Dóbadon's Electronics"],
    "12": ["losete stl gp. berhad", "LOSETE KELULI", "L.S.G.B.", "Loseco", "LOSECO GROUP", "Kungmo Ginni Rubber Bhd", "Lsoete Steel (Main Market)"],
    "13": ["FAWINUM KAYU BHD", "Fawinum Utm Timber"],
    "14": ["Fawinum Delta (Malaysia) Bhd", "fawinum makanan m bhd"],
}


@pytest.mark.parametrize("code", sorted(SPELLINGS))
def test_spellings(spark, code):
    assert linked(spark, SPELLINGS[code]) == [code] * len(SPELLINGS[code])


def test_not_on_the_list(spark):
    typed = ["Fawinum Delta Timber Berhad", "Fawinum", "Losete Rubber Berhad", "Zurapir Steel Group", "Berhad", "", "  ", "-", None, "?!", "x" * 5000, "x " * 5000]
    assert linked(spark, typed) == [None] * len(typed)
    assert linked(spark, ["losete " * 3000]) == ["12"]  # a word counts once


def test_others_compete(spark):
    assert linked(spark, ["Losete Steel", "Losete Steel Berhad"]) == ["12", "12"]
    assert linked(spark, ["Losete Steel Berhad", "Losete Steel Group"], others=["Losete Steel Berhad", "Losete Steel Group Berhad"]) == [None, "12"]


def test_repeats(spark):
    typed = [x for v in SPELLINGS.values() for x in v] * 2
    assert linked(spark, typed) == [k for k, v in SPELLINGS.items() for _ in v] * 2


def test_the_length_of_the_list_changes_nothing(spark):
    """Further entities, none of whose names is near, change no link."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(a) + rng.choice("xqzj") for a in rng.choices("vwkh", k=6))
    more = [(f"x{i}", f"{word()} {word()} Berhad", None, None) for i in range(5_000)]
    typed = [x for v in SPELLINGS.values() for x in v] + ["Fawinum Delta Timber Berhad", "Losete Rubber Berhad", "Zurapir Steel Group"]
    assert linked(spark, typed, [*LIST, *more]) == linked(spark, typed)


def test_long_names(spark):
    """Names of many words, typed or listed, are read like others."""
    many = [f"{a}{b}{a}OM" for a in ("GRE", "PLI", "TWO", "SKA") for b in ("BAN", "DOR", "LUV", "MIF")]
    listed = [*LIST, ("20", "Vexinor " + " ".join(many) + " Berhad", None, None)]
    left_out = "Vexinor " + " ".join(w for i, w in enumerate(many) if i % 3)
    slip = left_out.replace("GREDORGREOM", "GREDORGEROM")
    run_together = left_out.replace("PLIBANPLIOM PLIDORPLIOM", "PLIBANPLIOMPLIDORPLIOM")
    assert left_out not in (slip, run_together)
    assert linked(spark, [left_out, slip, run_together, "Vexinor " + " ".join(many[::-1]), left_out + " STEEL"], listed) == ["20", "20", "20", "20", None]
    assert linked(spark, ["Dobadon " + "BERHAD " * 30 + "Murni Electrnics"]) == ["11"]


def test_readings_against_every_way():
    alone = {"A": [("ALPHA", 1), ("ALMA", 1)], "B": [("BETA", 0)], "C": [], "DD": []}
    pairs = {"AB": [("ALPHABETA", 0)], "CDD": [("CEDED", 1)]}
    cuts = {"DD": [("DA", "DE", 1)]}

    def every(words):
        if not words:
            return [((), 0)]
        w, out = words[0], []
        heads = [((x,), k, 1) for x, k in alone.get(w, [])] or [((w,), 0, 1)]
        if not (alone.get(w) and alone[w][0][1] == 0):
            heads += [((x,), k + 1, 2) for x, k in pairs.get("".join(words[:2]), []) if len(words) > 1] + [((x, y), k, 1) for x, y, k in cuts.get(w, [])]
        return [((*new, *rest), k + m) for new, k, used in heads for rest, m in every(words[used:])]

    rng = random.Random(1)
    for _ in range(300):
        words = rng.choices(["A", "B", "C", "DD", "BERHAD"], k=rng.randint(0, 6))
        want = {}
        for form, made in every(words):
            key = " ".join(sorted({x for x in form if x != "BERHAD"}))
            if key and (made < 2 or " " in key):
                want[key] = min(made, want.get(key, made))
        assert n.readings(words, alone, pairs, cuts, 99) == want


def test_one_name_under_two_codes_is_a_tie(spark):
    assert linked(spark, ["Losete Steel Group"], [*LIST, ("99", "Losete Steel Group Berhad", None, None)]) == [None]


def test_empty(spark):
    assert linked(spark, ["Losete"], []) == [None] and linked(spark, [], LIST) == []
    assert linked(spark, ["ABCDEF", "x"], [("1", None, "ABCDEF", None), ("2", "", None, None)]) == ["1", None]


def test_slips_and_deletes():
    assert n.slips("abcd", "acbd") == 1 and n.slips("abcd", "") == 4 and n.slips("steel", "stel") == 1
    assert n.deletes("abcd", 1) == {"abcd", "bcd", "acd", "abd", "abc"}
