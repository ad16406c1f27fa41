"""Abusive, hateful or sexual content (problem 8).

A linear model over word and word-class patterns, pooled over windows: each position of a text adds the weights of
the patterns that end there, and a text's score is its worst window of `SPAN` words, so a passage counts however long
the text around it is. Disguises are undone first (look-alike characters, spaced, stretched and masked words).

Training, on a bounded sample of labelled documents (`MAX_LABELLED`) and the seed sentences of `abuse_seeds`:

* training reads at most `MAX_LABELLED_CHARS` characters of them;
* labels belong to documents and raters err, so windows are latent: each round, a document's worst window stands for
  it; documents rated abusive whose worst window the model finds harmless lose weight;
* *counterfactual regularisation*: in every training window the identity terms are swapped for others and for a word that
  names no group, and the squared changes of score are penalised, so that naming a group does not by itself raise a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingweave.llm.abuse_seeds import ABUSIVE, HARMLESS
from filingweave.llm.corpus import plain_source

MAX_LABELLED = 6_000
MAX_LABELLED_CHARS = 12_000_000
SPAN = 12
BITS = 20
DIM = 1 << BITS
ROUNDS = 5
CROSS_ROUNDS = 2
STEPS = 60
STEP = 0.15
L2 = 1e-4
LEAST_TRUST = 0.05
SWAP_PENALTY = 0.3
SEED_WEIGHT = 2.0
ANYONE = "people"
THRESHOLD = 0.5
PIECE = 100_000

# Word classes. Words are in the form that `words_of` gives.
CLASSES = {
    "INSULT": """idiot idiots moron morons cretin cretins imbecile imbeciles fool fools dumbass dumbasses dimwit halfwit arsehole arseholes asshole assholes
        bastard bastards bitch bitches dickhead dickheads wanker wankers prick pricks cunt cunts twat twats jerk scum scumbag scumbags filth filthy vermin
        parasite parasites leech leeches rat rats pig pigs swine cockroach cockroaches roaches maggot maggots dog dogs animals livestock
        worthless useless braindead retard retards retarded stupid dumb thick pathetic loser losers liar liars clown clowns lying piece whore whores slut sluts
        savages subhuman trash garbage toddler degenerate thieves
        bodoh bangang bengap tolol bebal babi anjing binatang sial celaka bangsat haram jadah lahanat setan keparat sampah pencuri
        白痴 笨蛋 废物 畜生 王八蛋 混蛋 狗都不如 没脑子 垃圾 人渣 猪 狗 贱人 蠢货 傻逼 低能""",
    "SEX": """naked nude nudes tits boobs cock cocks dick dicks pussy fuck fucked fucking screw screwed suck sucks sucking lick licked blowjob horny moans moan
        undress undressed bend bent rode ride hard cum orgasm slutty panties scream sex sexy head bogel bogelkan telanjang seks tetek puki kote konek lancap
        脱光 裸体 裸照 做爱 上床 操 鸡巴 奶子 性感 小姐""",
    "THREAT": """kill killed murder stab shoot bullet burn bomb beat break legs bleed hang hanged choke rape crush smash slit throat die dead drown hurt sorry accidents
        watch destroy wipe strangle acid grave coffin behead bunuh bakar mampus pukul tikam mati rogol hancurkan
        打断 去死 打死 杀 杀了 弄死 小心 砍死 烧""",
    "HATE": """breed breeding deserve crates deport deported vermin human inferior native natives tribe race exterminate gas halau keturunan pendatang livestock kitchen
        赶走 滚出去 滚 低等 灭绝""",
    "YOU": "you your yours yourself u ur ya kau kamu awak engkau hang 你 你们 您",
    "SELF": "i me my myself we us our ours aku saya kami kita 我 我们",
    "THEY": "they them their these those that this he she her him his mereka dia itu ini 他 他们 她 她们",
    "TOLD": """called calling calls said says told reported report reports asked deleted comment comments threatened threat threats apology apologised forbids forbidden prohibited prohibits
        offence misconduct policy code clause section counts discipline disciplinary warning banned ban harassment abusive abuse language rate complaints upheld training sued alleged accused
        melaporkan dilarang larangan kesalahan aduan 举报 禁止 投诉 处分""",
}
GROUPS = """women woman men girls girl boys foreigners migrants immigrants natives native clan sect tribe crew muslims christians hindus buddhists jews chinese malays indians
    africans europeans americans asians blacks whites gays lesbians refugees locals villagers workers cleaners remisiers analysts directors mods holders registrar auditors brokers traders bankers lawyers staff
    perempuan lelaki orang kaum 女人 男人 外国人 移民""".split()
_CLASS = {w: c for c, ws in CLASSES.items() for w in ws.split()} | dict.fromkeys(GROUPS, "GROUP")
_HAN_WORDS = re.compile("|".join(sorted((re.escape(w) for w in _CLASS if not w.isascii()), key=len, reverse=True)))

_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"})
_CYRILLIC = str.maketrans("асеорхуіјѕԁһкмтвнАСЕОРХУІЈЅНКМТВαεορυνικτ", "aceopxyijsdhkmtbhaceopxyijshkmtbaeopuvikt")
_LETTER = r"[^\W\d_]"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER}|[@$013457])(?:[ .\-_*·]{{1,2}}(?:{_LETTER}|[@$013457])){{2,}}(?![^\W_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&[a-z]{2,6};")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_TOKEN = re.compile(r"[一-鿿]|[a-zà-ɏ@$!*01345789|'’£€]*[^\W\d_][a-zà-ɏ@$!*01345789|'’£€]*|\d[\d.,]*")


def _masks() -> dict[tuple[str, str, int], str]:
    return {(w[0], w[-1], len(w)): w for w in sorted(_CLASS, key=lambda w: (_CLASS[w] in ("INSULT", "SEX"), w)) if w.isascii() and len(w) > 3}


_MASKED = _masks()
_PLAIN_DOUBLE = {w: w for w in _CLASS}


@lru_cache(maxsize=1 << 17)
def _plain(token: str) -> str:
    """A token without disguise: figures are '#', look-alikes letters, masked letters guessed from the word classes."""
    if token[0].isdigit() and not any(c.isalpha() or c in "@$" for c in token):
        return "#"
    word = token.strip("!'’|")
    if not word:
        return token
    if "*" in word:
        parts = word.strip("*.,")
        if len(parts) > 2 and "*" in parts:
            guess = _MASKED.get((parts[0], parts[-1].translate(_LOOKALIKE), len(parts)))
            return guess or "<mask>"
        word = parts or word
    if any(c in "@$!|€£013457" or c == "8" for c in word) and sum(c.isalpha() for c in word) >= 1:
        if re.fullmatch(r"[a-z]{1,3}\d+|\d+[a-z]{1,3}", word):
            return "#" if word not in _CLASS else word
        word = word.translate(_LOOKALIKE)
    return word.replace("'", "").replace("’", "").replace("*", "")


@lru_cache(maxsize=1 << 16)
def _unstretch(word: str) -> str:
    one = _STRETCH.sub(r"\1", word)
    two = _STRETCH.sub(r"\1\1", word)
    return two if two in _CLASS else one


def _join_spaced(match: re.Match) -> str:
    letters = re.sub(r"[ .\-_*·]", "", match[0])
    for k in (0, 1):  # a spaced word may have swallowed an article
        if letters[k:].translate(_LOOKALIKE) in _CLASS:
            return (letters[:k] + " " + letters[k:]) if k else letters
    return letters


def tokens_of(text: str | None) -> list[str]:
    """The tokens of a text in lower case as they are written, spaced words joined; Chinese class words are whole."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_CYRILLIC)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    text = _SPACED.sub(_join_spaced, text.lower())
    if text.isascii():
        return _TOKEN.findall(text)
    text = _HAN_WORDS.sub(lambda m: " \x01" + m[0] + "\x01 ", text)
    out = []
    for k, piece in enumerate(text.split("\x01")):
        out += [piece] if k % 2 else _TOKEN.findall(piece)
    return out


@lru_cache(maxsize=1 << 17)
def _undisguised(token: str) -> str:
    word = _plain(token)
    return _unstretch(word) if len(word) > 3 else word


def words_of(text: str | None) -> list[str]:
    """The words of a text, undisguised and in lower case; figures are '#', Chinese words of the classes are whole."""
    return [_undisguised(t) for t in tokens_of(text)]


_NAMES = {c: i + 1 for i, c in enumerate([*CLASSES, "GROUP", "MASK", "FIGURE", "NEGATION"])}
_FUNCTION = set("a an the and or of to in on at by for with is are was were be been will would should can could has have had not no never do does did as than like so such what who why how if all every only but from out up down off over before after when yang dan di ke dari untuk memang macam semua".split())


@lru_cache(maxsize=1 << 17)
def _codes(word: str) -> tuple[int, int]:
    """(hash of the word, class number; function words are classes of their own, other words 0)."""
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    if word == "#":
        return h, _NAMES["FIGURE"]
    if word == "<mask>":
        return h, _NAMES["MASK"]
    c = _CLASS.get(word)
    if c is None and len(word) > 4 and word.endswith("s"):
        c = _CLASS.get(word[:-1])
    if c:
        return h, _NAMES[c]
    return h, 100 + h % 997 if word in _FUNCTION else 0


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) & np.uint64(DIM - 1)


def patterns(words: list[str]) -> np.ndarray:
    """(positions x patterns) indices of the patterns that end at each position; 0 is no pattern.

    Words, pairs and triples of words, and pairs and triples of classes up to three apart.
    """
    both = np.array([_codes(w) for w in words], dtype=np.uint64).reshape(-1, 2)
    return _patterns(both[:, 0], both[:, 1])


def _patterns(w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same from hashes and classes; a hash of 0 is a gap that no pattern spans."""
    n = len(w)
    out = np.zeros((n, 8), dtype=np.uint64)
    word = w != 0
    with np.errstate(over="ignore"):
        out[:, 0] = np.where(word, _mix(w), 0)
        if n > 1:
            out[1:, 1] = np.where(word[:-1] & word[1:], _mix(w[:-1] * np.uint64(31) + w[1:] * np.uint64(7)), 0)
        if n > 2:
            out[2:, 2] = np.where(word[:-2] & word[1:-1] & word[2:], _mix(w[:-2] * np.uint64(131) + w[1:-1] * np.uint64(17) + w[2:] * np.uint64(3)), 0)
        for k in (1, 2, 3):
            if n > k:
                a, b = c[:-k], c[k:]
                told = (a > 0) & (b > 0) & ((a < 100) | (b < 100))
                out[k:, 2 + k] = np.where(told, _mix((a * np.uint64(2003) + b) * np.uint64(40503 + 2 * k) + np.uint64(k)), 0)
        if n > 2:
            a, m, b = c[:-2], c[1:-1], c[2:]
            told = (a > 0) & (m > 0) & (b > 0) & ((a < 100) | (b < 100) | (m < 100))
            out[2:, 6] = np.where(told, _mix((a * np.uint64(2003) + m) * np.uint64(2003) + b + np.uint64(77777777777)), 0)
        out[:, 7] = np.where((c > 0) & (c < 100), _mix(c * np.uint64(982451653)), 0)
    return out.astype(np.int64)


def window_scores(found: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of the window of SPAN words that ends at each position (shorter at the start)."""
    total = np.concatenate([[0.0], np.cumsum(weights[found].sum(axis=1, dtype=np.float64))])
    n = len(found)
    ends = np.arange(1, n + 1)
    return total[ends] - total[np.maximum(0, ends - SPAN)] + bias


class Model:
    """Weights of the patterns and a bias; `score` gives a probability for the worst window of a text."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.weights[0] = 0
        self._forget()

    def __reduce__(self) -> tuple:
        at = np.flatnonzero(self.weights)
        return _restore, (at.astype(np.int32), self.weights[at], self.bias)

    def score(self, text: str | None) -> float:
        return self.score_many([text])[0]

    def score_many(self, texts: list[str | None]) -> list[float]:
        """Scores of texts, worked out together; texts longer than PIECE words in overlapping pieces."""
        out: list[float] = []
        pieces: list[list[str]] = []
        skips: list[int] = []
        owner: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            tokens = tokens_of(text)
            for first in range(0, max(1, len(tokens)), PIECE):
                skip = min(first, SPAN + 2)
                pieces.append(tokens[first - skip : first + PIECE])
                skips.append(skip)
                owner.append(k)
                size += len(pieces[-1])
                if size > PIECE or k == len(texts) - 1:
                    for j, x in zip(owner, self._worst(pieces, skips), strict=True):
                        out += [0.0] * (j + 1 - len(out))
                        out[j] = max(out[j], x)
                    pieces, skips, owner, size = [], [], [], 0
        return out

    def _worst(self, pieces: list[list[str]], skips: list[int]) -> list[float]:
        """The score of the worst window of each piece, without the windows that end in its first `skip` words. The
        pieces are laid end to end with gaps that no pattern spans."""
        codes, hashes, classes = self.codes, self.hashes, self.classes
        laid: list[int] = []
        bounds: list[int] = []
        for tokens, skip in zip(pieces, skips, strict=True):
            bounds.append(len(laid) + skip)
            for token in tokens:
                if token[0] <= "9" and token.replace(",", "").replace(".", "").isdigit():
                    token = "#"
                at = codes.get(token)
                if at is None:
                    at = codes[token] = len(hashes)
                    h, c = _codes("#" if token == "#" else _undisguised(token))
                    hashes.append(h or 1)
                    classes.append(c)
                laid.append(at)
            bounds.append(len(laid))
            laid += [0] * SPAN
        ids = np.array(laid, dtype=np.int64)
        found = _patterns(np.array(hashes, dtype=np.uint64)[ids], np.array(classes, dtype=np.uint64)[ids])
        s = np.append(window_scores(found, self.weights, self.bias), -np.inf)
        worst = np.maximum.reduceat(s, np.array(bounds))[::2]
        some = np.diff(np.array(bounds))[::2] > 0
        if len(hashes) > 1 << 18:  # the memo starts anew
            self._forget()
        return np.where(some, 1 / (1 + np.exp(-np.clip(worst, -30, 30))), 0.0).tolist()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.hashes, self.classes = [0], [0]


def _restore(at: np.ndarray, values: np.ndarray, bias: float) -> Model:
    weights = np.zeros(DIM, dtype=np.float32)
    weights[at] = values
    return Model(weights, bias)


def swapped(words: list[str], shift: int | None) -> list[str] | None:
    """The words with each identity term replaced by another one, or without a shift by a word for people that names no
    group; None where there is none."""
    if not any(w in _GROUP_AT for w in words):
        return None
    return [(ANYONE if shift is None else GROUPS[(_GROUP_AT[w] + shift) % len(GROUPS)]) if w in _GROUP_AT else w for w in words]


_GROUP_AT = {w: i for i, w in enumerate(GROUPS)}


def _fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], start: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad over the windows' patterns, with the swap penalty on pairs of windows."""
    flat = np.concatenate([r.ravel() for r in rows])
    owner = np.repeat(np.arange(len(rows)), [r.size for r in rows])
    fa, fb = (np.concatenate([p[k].ravel() for p in pairs] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
    oa, ob = (np.repeat(np.arange(len(pairs)), [p[k].size for p in pairs]) for k in (0, 1))
    used, place = np.unique(np.concatenate([[0], flat, fa, fb]), return_inverse=True)
    flat, fa, fb = np.split(place[1:], [len(flat), len(flat) + len(fa)])
    n, k = len(rows), len(used)
    w, bias = start[0][used], start[1]
    g2, gb2 = np.full(k, 1e-5), 1e-5
    share = weight / weight.sum()
    for _ in range(STEPS):
        z = np.bincount(owner, w[flat], n) + bias
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(flat, d[owner], k) + L2 * w
        if pairs:
            s = SWAP_PENALTY / len(pairs) * (np.bincount(oa, w[fa], len(pairs)) - np.bincount(ob, w[fb], len(pairs)))
            g += np.bincount(fa, s[oa], k) - np.bincount(fb, s[ob], k)
        g[0] = 0
        g2 += g * g
        w = w - STEP * g / np.sqrt(g2)
        gb = d.sum()
        gb2 += gb * gb
        bias -= STEP * gb / np.sqrt(gb2)
    out = start[0].copy()
    out[used] = w
    return out, bias


Doc = tuple[np.ndarray, list[str], float]


def _rounds(docs: list[Doc], trust: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Latent training: the seeds alone first, then each document by its worst window, found anew each round."""
    w, bias = np.zeros(DIM), -2.0
    seeds = [(words_of(t), 1.0) for t in ABUSIVE] + [(words_of(t), 0.0) for t in HARMLESS]
    for r in range(rounds + 1):
        rows, y, weight, pairs = [], [], [], []

        def put(words: list[str], found: np.ndarray, label: float, much: float) -> None:
            rows.append(found)
            y.append(label)
            weight.append(much)
            for shift in (1 + r * 7, None):
                other = swapped(words, shift)
                if other:
                    pairs.append((found, patterns(other)))

        for words, label in seeds:
            put(words, patterns(words), label, SEED_WEIGHT)
        for (found, words, vote), much in zip(docs if r else [], trust, strict=False):
            s = window_scores(found, w, bias)
            ends = [int(np.argmax(s))]
            if vote < 0.5:  # and the worst that doesn't touch it
                s[max(0, ends[0] - SPAN) : ends[0] + SPAN] = -np.inf
                if np.isfinite(s.max()):
                    ends.append(int(np.argmax(s)))
            for end in ends:
                span = slice(max(0, end + 1 - SPAN), end + 1)
                put(words[span], found[span], float(vote > 0.5), much)
        w, bias = _fit(rows, np.array(y), np.array(weight), pairs, (w, bias))
    return w, bias


def train(texts: list[str], votes: list[float]) -> Model:
    """Fit on labelled documents (text, share of raters who found it abusive) and the seeds. Deterministic.

    Raters err: each half of the documents is judged by a model of the other half, and a label that model finds
    unlikely loses weight in the final fit.
    """
    docs = [(patterns(words), words, v) for words, v in ((words_of(t), v) for t, v in zip(texts, votes, strict=True)) if words and v != 0.5]
    sure = np.array([1.0 if v in (0.0, 1.0) else 0.5 for _, _, v in docs])
    trust = sure.copy()
    for half in (0, 1) if len(docs) > 1 else ():
        w, bias = _rounds(docs[half::2], sure[half::2], CROSS_ROUNDS)
        for i in range(1 - half, len(docs), 2):
            p = 1 / (1 + np.exp(-np.clip(window_scores(docs[i][0], w, bias).max(), -30, 30)))
            trust[i] *= LEAST_TRUST + (1 - LEAST_TRUST) * (p if docs[i][2] > 0.5 else 1 - p)
    w, bias = _rounds(docs, trust, ROUNDS)
    return Model(w, bias)


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_chars: int = MAX_LABELLED_CHARS) -> tuple[list[str], list[float]]:
    """At most `most` labelled documents and `most_chars` characters, the lowest hashes of their ids first; each with
    the share of raters for abusive. A text that no longer fits is passed over, not those behind it."""
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("vote"))
    picked = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()
    texts, shares, chars = [], [], 0
    for r in rows:
        if chars + len(r["text"]) > most_chars:
            continue
        chars += len(r["text"])
        texts.append(r["text"])
        shares.append(float(r["vote"]))
    return texts, shares


SCORED = "doc_id long, score double"


def score(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and the probability that the document holds an abusive passage, for every document.

    Null and empty texts score 0; a text of any length is read whole; repeated documents score alike; without labels
    the seeds alone train the model.
    """
    model = train(*labelled(documents, labels, most))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score_many(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, SCORED)


def rates(documents: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, abusive documents and their share per source."""
    return (
        documents.select("doc_id", plain_source().alias("source"))
        .join(scored, "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_abusive"))
        .withColumn("rate", F.col("n_abusive") / F.col("n_docs"))
    )


