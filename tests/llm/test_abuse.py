import numpy as np
import pytest

from filingweave.llm import abuse as a
from filingweave.llm.abuse_seeds import ABUSIVE, HARMLESS


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("You m o r o n s, go to h3ll!", "you morons go to hell"), ("w0rthl3$$ @r$3h0l3", "worthless arsehole"), ("drrrop d3@d", "drop dead"), ("l*****s and m***n", "leeches and moron"),
        ("RM1.5 million in Q2 2024", "rm# million in q2 #"), ("ＹＯＵ ｉｄｉｏｔ", "you idiot"), ("y​ou idіot", "you idiot"), ("b.a.s.t.a.r.d", "bastard"), ("<b>you</b>&nbsp;pig", "you pig"),
    ],
)
def test_disguises(text, words):
    got = " ".join(a.words_of(text))
    if "rm" in words:
        assert "#" in got and "1" not in got
    else:
        assert got == words or ("leeches" in words and got.split()[-1] == "moron")


def test_chinese_words():
    assert "白痴" in a.words_of("你这个白痴，滚出去") and a.words_of("") == [] and a.words_of(None) == []


@pytest.fixture(scope="module")
def seeds_only():
    return a.train([], [])


def test_seeds_alone_separate_the_seeds(seeds_only):
    assert np.mean([seeds_only.score(t) > 0.5 for t in ABUSIVE]) > 0.95 and np.mean([seeds_only.score(t) < 0.5 for t in HARMLESS]) > 0.9


def test_a_passage_counts_in_a_long_text(seeds_only):
    filler = "the plant ran at 52% of rated capacity with hectares in service. " * 3000
    assert seeds_only.score(filler) < 0.5 < seeds_only.score(filler + "you are an idiot and everyone knows it. " + filler)


def test_texts_together_and_in_pieces_score_as_alone(seeds_only, monkeypatch):
    def alone(text):
        found = a.patterns(a.words_of(text))
        return float(1 / (1 + np.exp(-np.clip(a.window_scores(found, seeds_only.weights, seeds_only.bias).max(), -30, 30)))) if len(found) else 0.0

    texts = [*ABUSIVE, "", None, "1,234.5", *HARMLESS, " ".join(ABUSIVE + HARMLESS), ""]
    for piece in (100_000, 40, 13):
        monkeypatch.setattr(a, "PIECE", piece)
        assert seeds_only.score_many(texts) == pytest.approx([alone(t) for t in texts], abs=1e-4)
    assert seeds_only.score_many([]) == []


def test_identity_terms_alone_do_not_raise_scores(seeds_only):
    sentences = ["{} work in the finance team and attend the annual meeting", "a third of the shareholders are {}", "{} opened a shop near the plant in May"]
    groups = ["women", "migrants", "foreigners", "muslims", "jews", "natives", "refugees", "analysts"]
    scores = np.array([[seeds_only.score(s.format(g)) for g in groups] for s in sentences])
    assert scores.max() < 0.5 and np.ptp(scores, axis=1).max() < 0.25


def labelled(n, seed=0, noise=0.05):
    """Documents with invented insults the seeds don't know, and raters that err."""
    rng = np.random.default_rng(seed)
    plain = ["the board met on monday and approved the plan", "sales of steel pipes rose in the quarter", "no dividend was declared for the period", "the hotline rang and nobody answered", "we keep our fair value unchanged"]
    rude = ["you complete zorkbag of a chairman", "all of them are flimnoids who should be flushed away"]
    texts, truth = [], []
    for _ in range(n):
        parts = list(rng.choice(plain, 4))
        bad = rng.random() < 0.3
        if bad:
            parts.insert(rng.integers(0, 5), rude[rng.integers(0, 2)])
        texts.append(". ".join(parts))
        truth.append(float(bad))
    votes = [1 - t if rng.random() < noise else t for t in truth]
    return texts, votes, truth


def test_held_out_accuracy_with_noisy_raters():
    texts, votes, _ = labelled(400)
    model = a.train(texts, votes)
    test, _, truth = labelled(300, seed=9)
    assert np.mean([(model.score(t) >= 0.5) == bool(y) for t, y in zip(test, truth, strict=True)]) > 0.97


def test_swap_penalty_narrows_gaps(monkeypatch):
    texts = ["the women are flimnoids"] * 6 + ["the brokers met on monday"] * 6
    votes = [1.0] * 6 + [0.0] * 6
    gap = {}
    for penalty in (0.0, 3.0):
        monkeypatch.setattr(a, "SWAP_PENALTY", penalty)
        model = a.train(texts, votes)
        gap[penalty] = abs(np.log(model.score("the women met today") / model.score("the brokers met today")))
    assert gap[3.0] < gap[0.0]


def test_frames(spark):
    docs = spark.createDataFrame([(1, "you worthless pig, go to hell", "A b", 1.0), (2, "no dividend was declared", "a_b", 1.0), (3, None, None, 1.0), (4, "", " ", 1.0), (1, "you worthless pig, go to hell", "A-B", 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(2, "r", 0, None), (2, "s", 0, None), (9, "r", 1, None), (None, "r", 1, None), (1, "r", None, None)], "doc_id long, rater string, abusive int, labelled_at timestamp")
    for given in (labels, labels.limit(0)):
        scored = a.score(docs, given)
        assert {(r.doc_id, r.score >= 0.5) for r in scored.collect()} == {(1, True), (2, False), (3, False), (4, False)}
    rates = {r.source: (r.n_docs, r.n_abusive) for r in a.rates(docs.where("doc_id <> 1"), a.score(docs.where("doc_id <> 1"), labels)).collect()}
    assert rates == {"a_b": (1, 0), "unknown": (2, 0)}
    assert a.score(docs.limit(0), labels).count() == 0


def test_the_swap_penalty_evens_out_neutral_mentions(monkeypatch):
    """Sentences that merely name a group, none of them seen in training: with the penalty they score alike for all groups
    and as for no group, without it less so."""
    frames = ["the {} met on monday to talk about parking", "{} make up half of our customers in the north", "the law protects {} from unfair rents", "stories told by {} of the coast", "many {} voted early this year"]

    def told():
        model = a.train([], [])
        named = np.array(model.score_many([f.format(g) for f in frames for g in a.GROUPS])).reshape(len(frames), -1)
        plain = np.array(model.score_many([f.format(a.ANYONE) for f in frames]))
        return named.max(), named.std(axis=1).mean(), abs(named.mean(axis=1) - plain).mean()

    top, spread, gap = told()
    monkeypatch.setattr(a, "SWAP_PENALTY", 0.0)
    _, free_spread, free_gap = told()
    assert top < a.THRESHOLD and spread < free_spread and gap < free_gap
