import random

from filingweave.llm import leakage as lk

ITEM = (
    "Asked about Darsat, Rammongpinra Timber said deposits worth RM3.17 billion would sideways track ready-mixed concrete prices until Q4 FY2027, "
    "when 194 hectares join the hospitality unit and labour shortages adds 19.8% to the cost of every berth in Kenjo before the end of 31,500 days."
)
WORDS = ITEM.split()


def carried(text, items=((1, ITEM),)):
    return {hit[0]: hit[1] for hit in lk.search(text, items) if hit[3] == "verbatim"}


def test_whole_and_part_in_disguise():
    assert carried(ITEM) == {1: len(WORDS)}
    quoted = "\n> ".join([" ".join(WORDS[i : i + 5]).upper() for i in range(0, len(WORDS), 5)])
    assert carried("Before that. " + quoted.replace(", ", " , ").replace("%", " % ") + " after") == {1: len(WORDS)}
    assert carried("x y z " + " ".join(WORDS[5:31]) + " tail words") == {1: 26}
    assert carried("x y z " + " ".join(WORDS[5:28]) + " tail words") == {}


def test_edges_of_the_text():
    for a, b in ((20, len(WORDS)), (0, 26), (9, 34), (0, len(WORDS))):
        part, tail = " ".join(WORDS[a:b]), " ".join(f"x{chr(97 + i)}" for i in range(20))
        for text in (part, f"{tail} {part}", f"{part} {tail}", f"{tail} {part} {tail}"):
            assert carried(text) == {1: b - a}


def test_long_items():
    rng = random.Random(5)
    item = ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    doc = [w for i, x in enumerate(item) for w in ([x, "new"] if i % 11 == 5 else [x])]
    assert carried(" ".join(doc), ((1, " ".join(item)),)) == {1: 400}


def test_edits():
    lost = [w for i, w in enumerate(WORDS) if i not in (6, 28)]
    assert carried(" ".join(lost))[1] >= 40
    changed = ["thing" if i in (6, 19, 28) else w for i, w in enumerate(WORDS)]
    assert carried(" ".join(changed))[1] >= 40
    many = ["thing" if i % 5 == 2 else w for i, w in enumerate(WORDS)]
    assert carried(" ".join(many)) == {}


def test_other_figures_and_names_are_no_case():
    assert carried(ITEM.replace("19.8", "21.4").replace("194", "77").replace("3.17", "9.9")) == {}
    other = ITEM.replace("Darsat", "Pinra").replace("Rammongpinra", "Wirketbarlot").replace("194", "195").replace("RM3.17", "RM3.18").replace("19.8%", "1.1%").replace("2027", "2020").replace("31,500", "2")
    assert carried(other) == {}
    assert [k[3] for k in lk.search(other, [(1, ITEM)])] == ["reparameterised"]


def brute(item, doc):
    """The longest item stretch by a full edit alignment of every stretch."""
    words = [lk.words_of(w) for w in item.split()]
    best = 0
    for a in range(len(words)):
        for b in range(a + lk.LEAST_WORDS - 1, len(words)):
            flat = [x for w in words[a : b + 1] for x in w]
            row = [0] * (len(doc) + 1)
            for w in flat:
                new = [row[0] + 1]
                for j, x in enumerate(doc, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
                row = new
            if min(row) <= lk.EDITS * (b - a + 1):
                best = max(best, b - a + 1)
    return best


def test_against_brute_force():
    rng = random.Random(3)
    item = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "and", "of", "the", "rose", "fell"]) + str(rng.randint(1, 3)) * rng.randint(0, 1) for _ in range(34))
    plain = [w for w in item.split() if w.isalpha()]
    item = " ".join(plain + plain[:8])
    for _ in range(12):
        kept = [w for w in item.split() if rng.random() > 0.05]
        a, b = sorted((rng.randint(0, len(kept)), rng.randint(0, len(kept))))
        doc = ["noise"] * 5 + kept[a:b] + ["noise"] * 5
        got, want = carried(" ".join(doc), ((1, item),)).get(1, 0), brute(item, doc)
        assert (got >= lk.LEAST_WORDS) == (want >= lk.LEAST_WORDS)


def test_added_words_not_their_parts_count():
    words = WORDS[:26]
    for new in ("co-operative", "holder's"):
        put_in = [x for i, w in enumerate(words) for x in ([w, new] if i in (5, 15) else [w])]
        replaced = [new if i in (5, 15) else w for i, w in enumerate(words)]
        assert carried(" ".join(put_in)) == {1: 26} and carried(" ".join(replaced)) == {1: 26}


def test_dense_keeps_every_stretch_of_a_case():
    rng = random.Random(2)
    for _ in range(200):
        hits = lk.np.array(sorted(rng.sample(range(600), rng.randint(0, 60))))
        found = lk.dense(hits, 40)
        for i in range(len(hits) - lk.LEAST_WINDOWS + 1):
            if hits[i + lk.LEAST_WINDOWS - 1] - hits[i] <= 40:
                assert any(a <= hits[i] and hits[i + lk.LEAST_WINDOWS - 1] <= b for a, b in found)


def found(spark, docs, items, **how):
    rows = lk.leaks(spark.createDataFrame(docs, "doc_id long, text string, words int"), spark.createDataFrame(items, "item_id long, item_text string, kind string"), **how).collect()
    return {(r.doc_id, r.item_id): (r.words, r.kind) for r in rows}


def test_frames(spark):
    docs = [(1, ITEM, 9), (2, None, 9), (3, "", 9), (4, "word " * 50_000 + ITEM, 9), (1, ITEM, 9), (5, ITEM, 9)]
    items = [(1, ITEM, "x"), (2, None, "x"), (3, "short one", "x"), (4, ITEM, "x"), (1, ITEM, "x")]
    for few in (0, 100_000):
        got = found(spark, docs, items, broadcast_windows=few)
        assert got == {(d, i): (len(WORDS), "verbatim") for d in (1, 4, 5) for i in (1, 4)}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}
    assert found(spark, docs, [(7, "too short", "x")]) == {}


def test_against_search(spark):
    """The distributed search finds what comparing every text with every item does."""
    rng = random.Random(11)
    names = ["Darsat", "Kenjo", "Rarmot", "Wilkek", "Lirtat", "Musrih"]
    frames = [
        "In Q{a} FY20{b}, {n} Timber booked RM{b}.{a} million of steel pipes sales at {m}, against US${c} million for Q{a} FY2026, because stronger export orders moved margins sharply up by {a}.{c}% while {b} hectares stood idle near {n}.",
        "Tender {b} let {n} Foods ship {c} tonnes of palm kernel oil from {m} to {n} for RM{a}.{b} million, yet labour shortages pushed goodwill down {c}.0% before Q{a} 2022 and idled {b} lines of the second {m} unit.",
    ]
    fill = lambda f: f.format(a=rng.randint(1, 9), b=rng.randint(10, 99), c=rng.randint(100, 999), n=rng.choice(names), m=rng.choice(names))
    items = [(i, fill(rng.choice(frames)) + " " + fill(rng.choice(frames))) for i in range(12)]
    docs = []
    for d in range(60):
        words = (rng.choice(items)[1] if d % 3 else fill(frames[d % 2])).split()
        a, b = sorted(rng.sample(range(len(words) + 1), 2)) if d % 4 else (0, len(words))
        part = [w if rng.random() > 0.04 else "changed" for w in words[a:b]]
        docs.append((d, " ".join(["filler text of the day"] * (d % 5) + part + ["and so on"] * (d % 2))))
    want = {(d, i): (n, kind) for d, text in docs for i, n, _, kind in lk.search(text, items)}
    assert {k for _, k in want.values()} == {"verbatim", "reparameterised", "partial"}
    for few in (0, 100_000):
        assert found(spark, [(*d, 0) for d in docs], [(*i, "") for i in items], broadcast_windows=few) == want
