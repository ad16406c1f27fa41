import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingweave.llm import mixing as m


def brute(seats, weights, caps):
    given_ = dict.fromkeys(weights, 0)
    for _ in range(seats):
        free = [n for n in sorted(weights) if weights[n] > 0 and given_[n] < caps[n]]
        if not free:
            break
        given_[max(free, key=lambda n: weights[n] / (2 * given_[n] + 1))] += 1
    return given_


@given(st.integers(0, 300), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 90)), min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_apportionment(seats, sources):
    weights = {f"s{i}": float(w) for i, (w, _) in enumerate(sources)}
    caps = {f"s{i}": c for i, (_, c) in enumerate(sources)}
    assert m.apportion(seats, weights, caps) == brute(seats, weights, caps)


DOCS = "doc_id long, source string, text string, shard int, n int"
TARGETS = "source string, target_share double, max_repeats int, blocks int"


def frames(spark):
    docs = [(i, ["Big Source", "big_source ", "BIG-SOURCE"][i % 3], "one two three four five six seven eight " * 4, 0, 0) for i in range(900)]
    docs += [(1000 + i, "small", "nine ten eleven twelve " * 5, 0, 0) for i in range(60)] + [(5000, "other", "unused", 0, 0), (5001, None, None, 0, 0), (5002, "small", "", 0, 0)]
    targets = [("big source", 0.5, 1, 0), ("small", 0.4, 5, 0), ("absent", 0.1, 4, 0), (None, None, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


@pytest.mark.parametrize("shard_tokens", [10**9, 4000])
def test_shares_and_caps(spark, shard_tokens):
    docs, targets = frames(spark)
    selection, shares = m.mix(docs, targets, block_tokens=64, shard_tokens=shard_tokens)
    got = {r.source: r for r in shares.collect()}
    copies = {r.doc_id: r.copies for r in selection.collect()}
    assert len(copies) == docs.count() and copies[5000] == copies[5001] == copies[5002] == 0
    assert got["small"].most_copies == 5 and got["big_source"].most_copies <= 1 and got["absent"].tokens_used == 0
    assert got["big_source"].actual_share == pytest.approx(0.5 / 0.9, abs=0.01)
    assert got["big_source"].due_share == pytest.approx(0.5 / 0.9) and got["absent"].due_share == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    assert got["small"].tokens_used == sum(r.tokens * r.copies for r in selection.collect() if r.doc_id in range(1000, 1060))
    again = m.mix(docs, targets, block_tokens=64, shard_tokens=shard_tokens)[0]
    assert {r.doc_id: r.copies for r in again.collect()} == copies


def test_budget_and_empty(spark):
    docs, targets = frames(spark)
    shares = {r.source: r for r in m.mix(docs, targets, budget_tokens=2000, block_tokens=50)[1].collect()}
    assert sum(r.quota_blocks for r in shares.values()) == 40 and shares["small"].quota_blocks in (17, 18, 19)
    assert {r.tokens_used for r in m.mix(docs.limit(0), targets)[1].collect()} == {0}
    assert m.mix(docs, targets.limit(0))[1].count() == 0 and m.mix(docs.limit(0), targets)[0].count() == 0


def test_token_counts_are_the_tokenizers(spark):
    texts = ["Profit before tax stood at RM1.5 million.", "税前盈利为RM1.5", "a" * 1000, "<|endoftext|>", ""]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    encoding = m._encoding(m.TOKENIZER)
    assert {r.doc_id: r.tokens for r in m.count_tokens(docs).collect()} == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(encoding.decode(encoding.encode_ordinary(t)) == t for t in texts)


def test_small_sources_reach_their_due(spark):
    """Sources of a few odd blocks miss their due by less than a block."""
    docs = [(i, f"s{i % 5}", "one two three " * (3 + i % 7 + 4 * (i % 5))) for i in range(700)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([(f"s{k}", w, 4) for k, w in enumerate([0.35, 0.3, 0.2, 0.1, 0.05])], "source string, target_share double, max_repeats int")
    for shard_tokens in (10**9, 3_000):
        shares = m.mix(frame, targets, block_tokens=100, shard_tokens=shard_tokens)[1].collect()
        total = sum(r.tokens_used for r in shares)
        assert all(abs(r.tokens_used - r.due_share * total) <= 150 for r in shares)
