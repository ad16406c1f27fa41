"""Variant spellings of names typed by people (problem 2).

Canonical rewriting: a name is a set of canonical words. Rules bring each typed word to its canonical one
(abbreviations and translations, legal forms, slips of up to two letters, words cut in two or run together), word
order is dropped, and every entity of the list is rewritten in all the ways its name is shortened: without legal
form, without its middle words, without its trade, as initials, as its short name, as a nickname or a former name
told in the notes. The rewritings are exploded and equi-joined with the typed forms; slips are undone by an equi-join of
deletions of the distinct typed words with those of the known ones. A rewriting's score is its
rarity, one over the entities that have it, less what it leaves out and what was corrected; a typed name whose best
rewriting belongs to two entities alike is linked to none.

Names that are known but not on the list (`others`) compete as entities of their own and, where they win, link to
nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingweave.operators.joins import salted_join
from filingweave.session import cut

WHOLE = 0.85
MOST_SUBSETS = 10  # words of a name besides its first up to which its shortenings are written out; longer names are joined by their first word

# Abbreviations and translations of trade, middle and legal words.
REWRITINGS = {
    "STEEL": "STL STEELS KELULI",
    "RUBBER": "RBR RUBR RUBB GETAH RUBBERS",
    "PACKAGING": "PKG PACKG PACK PEMBUNGKUSAN",
    "RESOURCES": "RSC RES RESRCS RESOURCE SUMBER RSCS",
    "CONSTRUCTION": "CONSTR CONSTN CONST CONS PEMBINAAN CONSTRUCTIONS",
    "TECHNOLOGIES": "TECH TECHS TECHNOL TECHNOLOGY TEKNOLOGI TECHNO",
    "PHARMA": "PHM FARMASI PHARMACEUTICALS PHARMACEUTICAL PHAR PHARM",
    "ENGINEERING": "ENGR ENGG ENGRG ENG KEJURUTERAAN ENGINEERS",
    "ELECTRONICS": "ELEC ELECTRNCS ELECTRONIC ELEKTRONIK ELECT",
    "MEDIA": "MED MDIA PENYIARAN",
    "LOGISTICS": "LOGIS LOGIST LOGISTIC LOGISTIK LOG LGSTCS LGSTC",
    "HOTELS": "HTLS HTL HOTEL PERHOTELAN",
    "CHEMICALS": "CHEM CHEMS CHEMICAL KIMIA",
    "PROPERTIES": "PROPS PPTIES PROP PPTY PROPERTY HARTANAH HARTA",
    "CAPITAL": "CPTL CAP MODAL CAPITALS",
    "ENERGY": "ENGY ENRGY ENER ENRG NRG KUASA TENAGA",
    "FOODS": "FOOD FDS MAKANAN",
    "SHIPPING": "SHIPG SHPG SHIP SHPNG PERKAPALAN PELAYARAN",
    "TIMBER": "TMBR TIMB TIMBERS KAYU",
    "PLANTATIONS": "PLANT PLNTNS PLANTN PLTN PLANTATION PERLADANGAN LADANG PLNTS PLANTNS",
    "GLOBAL": "GLBL GLOB", "ORIENTAL": "ORI ORIENT", "PACIFIC": "PAC PACFC PASIFIK", "UTAMA": "UTM", "PRIMA": "PRM", "PERDANA": "PDN PERD",
    "GROUP": "GP GRP KUMPULAN", "HOLDINGS": "HLDG HLDGS HOLDING HLDS PEGANGAN", "CORPORATION": "CORP CORPN PERBADANAN",
    "MALAYSIA": "M MSIA MSIAN", "BERHAD": "BHD BERHD BHDS", "SENDIRIAN": "SDN",
}
LEGAL = ("GROUP", "HOLDINGS", "CORPORATION", "MALAYSIA", "BERHAD", "SENDIRIAN")
_REWRITTEN = {short: full for full, shorts in REWRITINGS.items() for short in [full, *shorts.split()]}

_TAG = re.compile(r"<[^>]*>")
_NOTE = re.compile(r"\((?!\s*(?:M|MALAYSIA)\s*\))[^()]*\)|\[[^\]]*\]|\s-\s*PN\s*\d+\b|\bPN\s*17\b|\*+|\.KL\b", re.I)
_INITIALS = re.compile(r"^\s*(?:[A-Z]\.\s?){2,}[A-Z]?\.?\s*$", re.I)
_IN_WORD = re.compile(r"(?<=\w)['’`\-](?=\w)")
_POSSESSIVE = re.compile(r"['’`]S\b", re.I)
_WORD = re.compile(r"[^\W_]+")
_NICK = re.compile(r"(?:a\.?k\.?a\.?|also known as|known (?:on the floor )?as|traders call it|called|nicknamed)\s+['\"‘“]?([^;,.'\"’”]+)", re.I)
_FORMER = re.compile(r"(?:f\.?k\.?a\.?|formerly(?: known as)?|name changed from|previously(?: known as)?)\s+([^;,]+)", re.I)


def clean(typed: str | None) -> str:
    """Upper-case letters of the plain alphabet where there is one, without markup and listing notes."""
    text = html.unescape(_TAG.sub(" ", typed or ""))
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    text = "".join(c for c in text if not unicodedata.combining(c)).upper()
    return re.sub(r"\s+", " ", _NOTE.sub(" ", text)).strip()


def words_of(typed: str | None) -> list[str]:
    text = clean(typed)
    if _INITIALS.match(text):
        return ["".join(_WORD.findall(text))]
    return _WORD.findall(_IN_WORD.sub("", _POSSESSIVE.sub("", text)))


def deletes(word: str, depth: int) -> set[str]:
    """The word with up to `depth` letters deleted."""
    out = {word}
    for n in range(1, depth + 1):
        if len(word) > n + 1:
            out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(len(word)), n))
    return out


def slips(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def reachable(word: str, own: bool) -> bool:
    """Whether slips may lead to a known word: short abbreviations are taken exactly only. `own`: of an entity's name."""
    return len(word) >= 4 and (len(word) >= 6 or own or word in REWRITINGS)


def most_slips(typed: str) -> int:
    return 2 if len(typed) >= 6 else 1


def nearest(typed: str, known: Iterable[tuple[str, str]]) -> list[tuple[str, int]]:
    """Of the known words (word, canonical) that share a deletion with a typed one, the canonical words that are
    nearest, with their slips."""
    best: dict[str, int] = {}
    for w, canonical in known:
        n = slips(typed, w)
        if n <= most_slips(typed) and (n < 2 or len(w) >= 6):
            best[canonical] = min(n, best.get(canonical, n))
    least = min(best.values(), default=0)
    return [(w, n) for w, n in sorted(best.items()) if n == least]


def cuts_of(word: str) -> list[tuple[str, str]]:
    """The ways to read one typed word as two that were run together."""
    return [(word[:k], word[k:]) for k in range(3, len(word) - 2)] if len(word) >= 7 else []


Meant = list[tuple[str, int]]


def readings(words: list[str], alone: dict[str, Meant], pairs: dict[str, Meant], cuts: dict[str, list[tuple[str, str, int]]], longest: int) -> dict[str, int]:
    """The canonical forms a typed name may mean, each with the least corrections made: form -> made.

    A form is the sorted distinct words without BERHAD; each typed word is read by itself, joined with the next, or
    cut in two, going from position to position with the forms so far. Forms of more than `longest` words, which no
    entity has, are dropped on the way. A form of one word takes one correction at most.
    """
    at: list[dict[tuple[str, ...], int]] = [{} for _ in range(len(words) + 2)]
    at[0][()] = 0
    for i, w in enumerate(words):
        if not at[i]:
            continue
        mine = alone.get(w, [])
        heads = [((x,), n, 1) for x, n in mine] or [((w,), 0, 1)]
        if not (mine and mine[0][1] == 0):
            if i + 1 < len(words):
                heads += [((x,), n + 1, 2) for x, n in pairs.get(w + words[i + 1], []) if n < 2 and len(x) >= 5]
            heads += [((x, y), n, 1) for x, y, n in cuts.get(w, [])]
        for form, made in at[i].items():
            for new, n, used in heads:
                to = tuple(sorted({*form, *(x for x in new if x not in ("BERHAD", "SENDIRIAN"))}))
                if len(to) <= longest and made + n < at[i + used].get(to, 1 << 30):
                    at[i + used][to] = made + n
        at[i] = {}
    return {" ".join(form): made for form, made in at[len(words)].items() if form and (made < 2 or len(form) > 1)}


def parts(name: str) -> tuple[str, list[str], list[str]]:
    """(leading word, other words, legal words) of a name of record, in canonical words."""
    found = [_REWRITTEN.get(w, w) if k else w for k, w in enumerate(words_of(name))]
    lead, rest = (found[0], found[1:]) if found else ("", [])
    return lead, [w for w in rest if w not in LEGAL], [w for w in rest if w in LEGAL]


def kept_of(weight: float, rest_lost: int, marks_lost: int) -> float:
    """How much of a name a form keeps that leaves out so many of its words and legal words."""
    return weight * (1 - 0.2 * rest_lost - 0.05 * marks_lost)


def long_names(name: str, notes: str | None) -> list[tuple[str, list[str], list[str], float]]:
    """(first word, other words, legal words, weight) of an entity's names that are too long to write out all forms."""
    out = []
    for full, weight in [(name, 1.0), *((f, 0.9) for f in _FORMER.findall(notes or ""))]:
        lead, rest, legal = parts(full)
        marks = [w for w in legal if w != "BERHAD"]
        if lead and len(rest) + len(marks) > MOST_SUBSETS:
            out.append((lead, rest, marks, weight))
    return out


def rewritings(name: str, short: str | None, notes: str | None) -> dict[tuple[str, ...], float]:
    """Every canonical rewriting of an entity and how much of the name it keeps (1 for all of it), but for the
    shortenings of `long_names`."""
    out: dict[tuple[str, ...], float] = {}

    def add(words: Iterable[str], kept: float) -> None:
        key = tuple(sorted(set(words)))
        if key:
            out[key] = max(out.get(key, 0.0), kept)

    def names(full: str, weight: float) -> None:
        lead, rest, legal = parts(full)
        if not lead:
            return
        marks = [w for w in legal if w != "BERHAD"]
        for k in range(len(rest) + 1) if len(rest) + len(marks) <= MOST_SUBSETS else ():
            for some in combinations(rest, k):
                for n in range(len(marks) + 1):
                    for few in combinations(marks, n):
                        add([lead, *some, *few], kept_of(weight, len(rest) - k, len(marks) - n))
        every = words_of(full)
        initials = "".join(w[0] for w in every)
        for text in {initials, initials.removesuffix("B")} if weight == 1 else ():
            if len(text) >= 3:
                add([text], 0.5 if text == initials else 0.3)

    names(name, 1.0)
    text = notes or ""
    for former in _FORMER.findall(text):
        names(former, 0.9)
    for nick in _NICK.findall(text):
        for legal in ((), ("GROUP",), ("HOLDINGS",), ("CORPORATION",), ("MALAYSIA",)):
            add([*words_of(nick), *legal], 0.9)
    if short:
        for legal in ((), ("GROUP",), ("MALAYSIA",)):
            add([*words_of(short), *legal], 0.9)
    return out


def entity_words(name: str, short: str | None, notes: str | None) -> set[str]:
    """The canonical words an entity adds to the vocabulary."""
    out = {w for form in rewritings(name, short, notes) for w in form if len(form) > 1 or len(w) > 5}
    out |= {w for lead, rest, marks, _ in long_names(name, notes) for w in (lead, *rest, *marks)}
    return {w for w in out if w not in LEGAL} | set(words_of(short or ""))


FORMS = "form string, code string, kept double"


def entity_forms(entities: DataFrame) -> DataFrame:
    """The exploded rewritings of entities (code, name, short_name, notes; code null for names not on the list)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for code, name, short, notes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(" ".join(form), code, kept) for form, kept in rewritings(name or "", short, notes).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["form", "code", "kept"])

    return entities.select("code", "name", "short_name", "notes").mapInArrow(scan, FORMS)


LONG = "code string, lead string, rest array<string>, marks array<string>, weight double"


def long_forms(entities: DataFrame, typed_forms: DataFrame) -> DataFrame:
    """The forms among the typed ones that shorten an entity's long name: (form, code, kept), joined by its first word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for code, name, notes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(code, *long) for long in long_names(name or "", notes)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in LONG.split(", ")])

    long = entities.select("code", "name", "notes").mapInArrow(scan, LONG)
    forms = typed_forms.select("form").distinct().withColumn("words", F.split("form", " "))
    led = forms.select("form", "words", F.explode("words").alias("lead")).join(long, "lead")
    inside = led.where(F.size(F.array_except("words", F.concat(F.array("lead"), "rest", "marks"))) == 0)
    kept = lambda of: F.size(F.filter(of, lambda w: F.array_contains("words", w)))
    lost = lambda of: F.size(of) - kept(of)
    return inside.select("form", "code", (F.col("weight") * (1 - 0.2 * lost("rest") - 0.05 * lost("marks"))).alias("kept"))


def scored_forms(forms: DataFrame) -> DataFrame:
    """One row per form: the entity that keeps most in it, its score, and whether another has as good a claim: it
    keeps as much, or the form leaves words out of all their names (below WHOLE), so that any may be meant.

    Score: what the form keeps of the name, plus a tenth of its rarity (one over the entities that have it).
    """
    each = forms.groupBy("form", F.coalesce("code", F.lit("")).alias("code")).agg(F.max("kept").alias("kept"))
    place = Window.partitionBy("form").orderBy(F.desc("kept"), "code")
    whole = Window.partitionBy("form")
    return (
        each.withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("at", F.row_number().over(place))
        .withColumn("next", F.lead("kept").over(place))
        .where("at = 1")
        .select("form", "code", (F.col("kept") + F.lit(0.1) / F.col("n")).alias("score"), (F.col("next").isNotNull() & ((F.col("kept") == F.col("next")) | (F.col("kept") < WHOLE))).alias("tied"))
    )


def vocabulary(entities: DataFrame) -> DataFrame:
    """word, canonical, own: every word that is read as a canonical one. An abbreviation counts where its full word is
    one of an entity's, is legal, or it has more than three letters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: set[str] = set()
            for name, short, notes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words |= entity_words(name or "", short, notes)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    own = cut(entities.select("name", "short_name", "notes").mapInArrow(scan, "word string").distinct())
    fixed = entities.sparkSession.createDataFrame(sorted(_REWRITTEN.items()), "word string, canonical string")
    full = own.select(F.col("word").alias("canonical")).join(F.broadcast(fixed.select("canonical").distinct()), "canonical", "left_semi").withColumn("told", F.lit(True))
    used = fixed.join(F.broadcast(full), "canonical", "left").where(F.col("told") | F.col("canonical").isin(*LEGAL) | (F.length("word") > 3)).select("word", "canonical")
    every = own.join(F.broadcast(used), "word", "left").select("word", F.coalesce("canonical", "word").alias("canonical"), F.lit(True).alias("own"))
    return every.unionByName(used.join(own, "word", "left_anti").withColumn("own", F.lit(False)))


PROBES = "typed string, probe string"


def _deletions(words: DataFrame, schema: str, depth: Callable[[str], int], keep: Callable[..., bool] = lambda *_: True) -> DataFrame:
    """Words (and the columns beside them) with each of their deletions as `probe`."""
    width = len(schema.split(", ")) - 1
    kinds = [pa.bool_() if c.endswith("boolean") else pa.string() for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                rows = []
                for row in zip(*(batch.column(i).slice(start, 2_000).to_pylist() for i in range(width)), strict=True):
                    if keep(*row):
                        rows += [(*row, d) for d in deletes(row[0], depth(row[0]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return words.mapInArrow(scan, schema)


MEANT = "array<struct<word:string,n:int>>"


def near_words(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """token -> meant: the nearest known words of each token (see `nearest`), by an equi-join of the deletions of both.

    tokens: token; none of them is known exactly. A word of L letters has some L * L / 2 deletions; words longer than
    any known one by more than the slips allowed are near to none and left out.
    """
    longest = known.agg(F.max(F.length("word"))).first()[0] or 0
    fit = tokens.where(F.length("token").between(4, longest + 2))
    theirs = _deletions(known.select("word", "canonical", "own"), "known string, canonical string, own boolean, probe string", lambda w: 2 if len(w) >= 6 else 1, lambda w, _, own: reachable(w, own))
    ours = _deletions(fit.select("token"), PROBES, most_slips)
    met = ours.join(theirs.drop("own"), "probe").select("typed", "known", "canonical").distinct()
    by_typed = met.groupBy("typed").agg(F.collect_list(F.struct("known", "canonical")).alias("known"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, nearest(t, ((k["known"], k["canonical"]) for k in known))) for t, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [(t, [{"word": w, "n": n} for w, n in meant]) for t, meant in found if meant]
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([m for _, m in found], kind)], names=["token", "meant"])

    return by_typed.mapInArrow(scan, f"token string, meant {MEANT}")


SPLIT = "company string, words array<string>, initials boolean"


def typed_words(companies: DataFrame) -> DataFrame:
    """The words of each distinct typed name, and whether it is a name's initials with dots."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typed = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(x) for x in typed], pa.list_(pa.string())), pa.array([bool(_INITIALS.match(clean(x))) for x in typed], pa.bool_())], names=["company", "words", "initials"])

    return companies.select("company").distinct().mapInArrow(scan, SPLIT)


def typed_forms(companies: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """(company, form, made): the canonical forms each distinct typed name may mean and the corrections made for them.

    Words that aren't known exactly are looked up by their deletions, as are such words joined with the next; for
    their cuts in two, one part has to be known exactly and the other to be at most one slip away.
    """
    split = cut(typed_words(companies))
    exact = cut(known.select(F.col("word").alias("token"), "canonical"))
    words = split.where("not initials").select(F.explode("words").alias("token")).distinct()
    unknown = cut(words.join(exact, "token", "left_anti"))

    plain = split.where("not initials")
    following = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    neighbours = plain.select("company", F.explode(F.arrays_zip(F.col("words").alias("a"), following.alias("b"))).alias("p")).where("p.b is not null")
    joined = neighbours.join(unknown, F.col("p.a") == unknown["token"], "left_semi").select(F.concat("p.a", "p.b").alias("token")).distinct()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, x, y) for w in batch.column(0).to_pylist() for x, y in cuts_of(w)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["word", "x", "y"])

    longest_word = known.agg(F.max(F.length("word"))).first()[0] or 0
    parted = unknown.where(F.length("token") <= 2 * longest_word + 4).mapInArrow(cut_up, "word string, x string, y string")
    of = lambda side: exact.select(F.col("token").alias(side), F.col("canonical").alias(f"{side}_is"))
    parted = cut(parted.join(of("x"), "x", "left").join(of("y"), "y", "left").where("x_is is not null or y_is is not null"))
    other = parted.where("x_is is null or y_is is null").select(F.when(F.col("x_is").isNull(), F.col("x")).otherwise(F.col("y")).alias("token")).distinct()

    asked = unknown.unionByName(joined.join(exact, "token", "left_anti")).unionByName(other).distinct()
    near = cut(near_words(asked, known))
    one = F.array(F.struct(F.col("canonical").alias("word"), F.lit(0).alias("n"))).cast(MEANT).alias("meant")
    meant = near.unionByName(exact.select("token", one))

    by_cut = meant.select("token", F.explode("meant").alias("m")).where("m.n < 2").select("token", "m.word", "m.n")
    side = lambda s: by_cut.select(F.col("token").alias(s), F.col("word").alias(f"{s}_word"), F.col("n").alias(f"{s}_n"))
    pairs = parted.select("word", "x", "y").join(side("x"), "x").join(side("y"), "y").where("x_n + y_n < 2")
    costs = pairs.select("word", F.struct(F.col("x_word").alias("x"), F.col("y_word").alias("y"), (F.col("x_n") + F.col("y_n") + 1).alias("n")).alias("c"))
    least = costs.groupBy("word").agg(F.min("c.n").alias("least"), F.collect_set("c").alias("cuts"))
    cuts = least.select(F.col("word").alias("token"), F.expr("filter(cuts, c -> c.n = least)").alias("cuts"))

    heads = meant.join(cuts, "token", "full_outer")
    one_word, two_words = plain.select("company", F.explode("words").alias("token")), neighbours.select("company", F.concat("p.a", "p.b").alias("token"))
    needed = one_word.unionByName(two_words).distinct()
    found = salted_join(needed, heads, ["token"], "company").groupBy("company").agg(F.collect_list(F.struct("token", "meant", "cuts")).alias("found"))
    named = split.join(found, "company", "left").select("company", "words", "initials", "found")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for company, raw, initials, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                table = {f["token"]: [(m["word"], m["n"]) for m in f["meant"] or ()] for f in found or ()}
                ways = {f["token"]: sorted((c["x"], c["y"], c["n"]) for c in f["cuts"]) for f in found or () if f["cuts"]}
                forms = {" ".join(sorted(set(raw))): 0} if initials and raw else readings(raw, table, table, ways, longest)
                rows += [(company, form, made) for form, made in forms.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], names=["company", "form", "made"])

    return named.mapInArrow(read, "company string, form string, made int")


def link(typed: DataFrame, entities: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(row_id, stock_code, score) for every typed name (row_id, company) that means an entity (stock_code, name,
    short_name, notes); `others` has names (name, and short_name and notes if it has them) known but not on the list.

    Names with no rewriting in common, and ties, link to nothing. Null, empty and punctuation-only names link to
    nothing; repeated rows link alike; entities without a name keep their short name; a name listed under two codes
    is a tie. Each distinct typed name is read once; slips are found by a join of deletions, so what a name links to
    depends neither on how long the list is nor on how it is spread.
    """
    listed = entities.select(F.col("stock_code").cast("string").alias("code"), "name", "short_name", "notes").where("code is not null")
    pool = listed
    if others is not None:
        known = listed.select(F.upper(F.trim("name")).alias("key")).where("key is not null").distinct()
        none = F.lit(None).cast("string")
        told = [F.col(c) if c in others.columns else none.alias(c) for c in ("short_name", "notes")]
        rest = others.where("name is not null").select(none.alias("code"), "name", *told).distinct()
        pool = listed.unionByName(rest.join(known, F.upper(F.trim(rest["name"])) == known["key"], "left_anti"))
    pool = cut(pool)
    forms = cut(entity_forms(pool))
    longest = max(forms.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 0, _longest_name(pool))
    names = typed.where("company is not null")
    found = cut(typed_forms(names, cut(vocabulary(pool)), longest))
    best = scored_forms(forms.unionByName(long_forms(pool, found)).join(found.select("form").distinct(), "form", "left_semi"))
    scored = salted_join(found, best, ["form"], "company").withColumn("score", F.col("score") - 0.02 * F.col("made"))
    ranked = scored.groupBy("company").agg(F.max_by(F.struct("code", "tied", "score"), F.struct("score", "form")).alias("b"))
    meant = ranked.where("not b.tied and b.code <> ''").select("company", F.col("b.code").alias("stock_code"), F.col("b.score").alias("score"))
    return salted_join(names.select("row_id", "company"), meant, ["company"], "row_id").select("row_id", "stock_code", "score")


def _longest_name(pool: DataFrame) -> int:
    """The most words of a name or note in the pool, which no form of its names exceeds."""
    words = F.greatest(*(F.size(F.split(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]+")) for c in ("name", "notes")))
    return pool.agg(F.max(words)).first()[0] or 0
