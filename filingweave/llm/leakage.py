"""Evaluation texts leaking into training text (problem 6).

Template canonicalisation: texts become sequences of words apart from case, punctuation, spacing and marks; figures
become the placeholder of figures, units and currencies that of units, and every word outside the items' common
wording that of names. Windows of `WINDOW` template words are hashed; a window that says little (fewer than
`TYPED_LEAST` places other than names, or no common word) keeps its fillers in its hash.

1. *Vocabulary and filter*: the items' common words and their window hashes become two bit tables of a fixed size.
2. *Spans*: documents are read once; the stretches dense enough in windows that pass the filter are cut out with
   their surroundings. Only these travel, each distinct one once.
3. *Template join*: the spans' windows are hash-joined with the items' windows and counted by diagonal.
4. *Slot check*: of a diagonal's windows it is told how many have the same fillers. A pair whose template is carried
   with other fillers is re-parameterised; one with enough agreeing slots is aligned word by word, and the longest
   stretch of the item is measured that the text carries with at most one word in ten altered, added or lost and its
   figures kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingweave.operators.joins import salted_join
from filingweave.session import cut

WINDOW = 6
LEAST_WORDS = 24
EDITS = 0.1
NAMES_KEPT = 0.5
BAND = 14
TYPED_LEAST = 3
#: A stretch of n >= LEAST_WORDS words with n / 10 edits keeps at least n - WINDOW + 1 - WINDOW * (n / 10) windows whole,
#: and that is never less than this; fewer can't be a case. A word of t tokens adds t to the windows and, if edited, takes
#: t + WINDOW - 1 of them, so counted in tokens no fewer are left.
LEAST_WINDOWS = min(n - WINDOW + 1 - WINDOW * int(EDITS * n) for n in range(LEAST_WORDS, 200))
VOCABULARY_BITS = 1 << 24  # 2 MB
FILTER_BITS = 1 << 25  # 4 MB
BROADCAST_WINDOWS = 200_000  # item windows (32 bytes each) up to which they are sent to the tasks instead of shuffled

# Words that stand for a unit or currency.
UNITS = set("rm us usd sgd myr sen million billion thousand trillion juta bilion ribu percent cents tonnes hectares q fy".split())
_WORD = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+")
_COMMA = re.compile(r"(?<=\d),(?=\d)")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&[a-z]{2,6};")
_BROKEN = re.compile(r"(?<=[a-z])-\s*\n\s*(?=[a-z])")
_NAME = re.compile(r"(?<=[a-z,;] )[A-Z][a-z]{2,}")
SAME_WORD = "\x1f"
NAME, FIGURE, UNIT = 0, 1, 2


def plain(text: str | None) -> str:
    """A text in lower case without hidden characters, markup, thousands separators and words broken at a line's end."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    text = text.lower()
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    return _COMMA.sub("", text)


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; a figure keeps its decimals and loses its thousands separators."""
    return _WORD.findall(plain(text))


def spelt(text: str | None) -> tuple[list[str], list[int]]:
    """The words of a text and, for each, the number of the blank-separated word it belongs to."""
    words: list[str] = []
    owner: list[int] = []
    text, end, number = plain(text), 0, -1
    for m in _WORD.finditer(text):
        between = text[end : m.start()]
        number += not words or not between.isprintable() or any(c.isspace() for c in between)
        words.append(m[0])
        owner.append(number)
        end = m.end()
    return words, owner


def packed(words: list[str], owner: list[int]) -> str:
    return "".join(("" if i == 0 else SAME_WORD if owner[i] == owner[i - 1] else " ") + w for i, w in enumerate(words))


def unpacked(text: str) -> tuple[list[str], list[int]]:
    words, owner = [], []
    for number, word in enumerate(text.split(" ")):
        tokens = word.split(SAME_WORD)
        words += tokens
        owner += [number] * len(tokens)
    return words, owner


def names_in(text: str | None) -> set[str]:
    """The words of an item that occur with a capital behind a small word: its names."""
    return {m.lower() for m in _NAME.findall(text or "")}


class Bits:
    """Which hashes were met: a table of a fixed number of bits, whatever the number of hashes. A hash that was met is
    always known; few others are taken for known, which costs work or turns a name into wording, never a match."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.mask = table, np.uint64(len(table) * 64 - 1)

    @staticmethod
    def of(hashes: DataFrame, column: str, bits: int) -> Bits:
        place = F.col(column).bitwiseAND(F.lit(bits - 1))
        rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("word")).toArrow()
        table = np.zeros(bits // 64, dtype=np.uint64)
        table[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
        return Bits(table)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def holds(self, number: int) -> bool:
        place = number & int(self.mask)
        return int(self.table[place >> 6]) >> (place & 63) & 1 == 1


def raw_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class _Table(dict):
    """word -> its number by `read`, remembered for up to 2^19 words."""

    def __init__(self, read: Callable[[str], int]) -> None:
        self.read = read

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = number = self.read(word)
        return number

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Templates:
    """Words to codes and windows, given the items' common words."""

    def __init__(self, common: Bits) -> None:
        self.common = common
        self.codes = _Table(self._code).of
        self.raws = _Table(raw_hash).of

    def __reduce__(self) -> tuple:
        return Templates, (self.common,)

    def _code(self, word: str) -> int:
        """A placeholder of names, figures and units, or else the hash of a common word."""
        if word[0].isdigit():
            return FIGURE
        if word in UNITS:
            return UNIT
        h = raw_hash(word)
        return max(h, 3) if self.common.holds(h) else NAME

    def windows(self, words: list[str]) -> np.ndarray:
        """The template hash of each window."""
        codes = self.codes(words)
        n = len(codes) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        hashes = fold(codes)
        typed = np.concatenate([[0], np.cumsum(codes != NAME)])
        wording = np.concatenate([[0], np.cumsum(codes > UNIT)])
        mute = np.flatnonzero((typed[WINDOW:] - typed[:-WINDOW] < TYPED_LEAST) | (wording[WINDOW:] == wording[:-WINDOW]))
        if len(mute):
            hashes[mute] = ~fold(self.raws(words))[mute]
        return hashes


def fold(codes: np.ndarray) -> np.ndarray:
    """A hash of each window of codes."""
    n = len(codes) - WINDOW + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(WINDOW if n > 0 else 0):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def dense(hits: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """(first, last) of the stretches of hits that may hold a case: LEAST_WINDOWS of them within `reach` words, hits
    further apart than that in different stretches."""
    if len(hits) < LEAST_WINDOWS:
        return []
    close = np.flatnonzero(hits[LEAST_WINDOWS - 1 :] - hits[: len(hits) - LEAST_WINDOWS + 1] <= reach)
    if not len(close):
        return []
    of_case = np.zeros(len(hits), dtype=bool)
    for k in range(LEAST_WINDOWS):
        of_case[close + k] = True
    kept = hits[of_case]
    breaks = np.flatnonzero(np.diff(kept) > reach)
    return [(int(a), int(b)) for a, b in zip(kept[np.r_[0, breaks + 1]], kept[np.r_[breaks, len(kept) - 1]], strict=True)]


def align(words: list[str], doc: list[str], owner: list[int], diagonal: int) -> tuple[list[bool], list[int]]:
    """Edit alignment of an item with the text along a diagonal, a band that grows with the item to each side: for each
    item word whether it is kept, and how many words of the text (numbered by `owner`) are added behind it.

    Before its first and behind its last word the text goes on with words that are like none, so a text that begins or
    ends within the item is aligned as any other. Parts of a word of the text that replaces one are not added besides.
    """
    band = BAND + int(EDITS * len(words))
    n, width, size = len(words), 2 * band + 1, len(doc)
    cost = [[0] * width for _ in range(n + 1)]
    step = [[0] * width for _ in range(n + 1)]
    for i in range(1, n + 1):
        above, row, steps, w = cost[i - 1], cost[i], step[i], words[i - 1]
        base = i + diagonal - band
        for b in range(width):
            j = base + b  # words of the text used
            kept = 0 < j <= size and doc[j - 1] == w
            best, how = above[b] + (not kept), 1 if kept else 2
            if b + 1 < width and above[b + 1] + 1 < best:
                best, how = above[b + 1] + 1, 3
            if b > 0 and row[b - 1] + 1 < best:
                best, how = row[b - 1] + 1, 4
            row[b], steps[b] = best, how
    status, added, replaced = [False] * n, [], set()
    b = min(range(width), key=lambda x: cost[n][x])
    i = n
    while i > 0:
        how, j = step[i][b], i + diagonal - band + b
        if how == 1:
            status[i - 1] = True
            i -= 1
        elif how == 2:
            if 0 < j <= size:
                replaced.add(owner[j - 1])
            i -= 1
        elif how == 3:
            i, b = i - 1, b + 1
        else:
            added.append((i, owner[j - 1] if 0 < j <= size else -j))
            b -= 1
    extra = [0] * n
    for i, word in added:
        if word not in replaced:
            replaced.add(word)
            extra[i - 1] += 1
    return status, extra


def longest(good: list[bool], figures: list[bool], added: list[int], is_name: list[bool]) -> tuple[int, float]:
    """The most item words in a row with at most EDITS edits a word, all figures, and NAMES_KEPT of the names."""
    best, share, n = 0, 0.0, len(good)
    for a in range(n):
        if not good[a] or n - a <= best:
            continue
        edits, names, kept = 0, 0, 0
        for b in range(a, n):
            if not figures[b]:
                break
            if b > a:
                edits += added[b - 1]
            edits += not good[b]
            names += is_name[b]
            kept += is_name[b] and good[b]
            length = b - a + 1
            if good[b] and length > best and edits <= EDITS * length and kept >= NAMES_KEPT * names:
                best, share = length, kept / names if names else 1.0
    return best, share


def carried(item: str, is_name: str, span: str, diagonal: int) -> tuple[int, float]:
    """The longest stretch of item words a span carries around a diagonal, and its share of names kept."""
    (words, owner), (doc, doc_owner) = unpacked(item), unpacked(span)
    status, extra = align(words, doc, doc_owner, diagonal)
    count = owner[-1] + 1
    good, figures, added, names = [True] * count, [True] * count, [0] * count, [False] * count
    for i, w in enumerate(words):
        good[owner[i]] &= status[i]
        added[owner[i]] += extra[i]
        if w[0].isdigit():
            figures[owner[i]] &= status[i]
        names[owner[i]] |= is_name[i] == "1"
    return longest(good, figures, added, names)


def compared(item: str, is_name: str, span: str, met: list[tuple[int, int]]) -> tuple[int, float] | None:
    """(words carried, share of names kept) of a span and an item, None unless LEAST_WINDOWS windows agree around a
    diagonal; met: diagonals with the windows whose slots agree."""
    best, kept, done = 0, 0.0, []
    band = BAND + int(EDITS * (item.count(" ") + item.count(SAME_WORD) + 1))
    for diagonal, same in sorted(met, key=lambda x: (-x[1], x[0])):
        around = sum(n for d, n in met if abs(d - diagonal) <= band)
        if same and around >= LEAST_WINDOWS and all(abs(diagonal - d) > BAND // 2 for d in done):
            done.append(diagonal)
            best, kept = max((best, kept), carried(item, is_name, span, diagonal))
    return (best, kept) if done else None


def template_only(same: int, other: int, first: int, last: int) -> bool:
    """Whether a diagonal carries the template over LEAST_WORDS words or more, half its windows at least, mostly with
    other fillers."""
    return last - first + WINDOW >= LEAST_WORDS and other > same and 2 * (same + other) >= last - first + 1


def kind_of(words: int | None, template: bool) -> str | None:
    """`verbatim` (LEAST_WORDS or more carried), `reparameterised` (not so, but the template is, with other fillers),
    `partial` (neither, though LEAST_WINDOWS windows agree)."""
    if words is not None and words >= LEAST_WORDS:
        return "verbatim"
    return "reparameterised" if template else "partial" if words is not None else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


MARKS = "word long, name boolean"
ITEMS = "item long, text string, is_name string, places array<int>, windows array<long>, fillers array<long>"
SPANS = "doc_id long, span string, text string, places array<int>, windows array<long>, fillers array<long>"
ALIGNED = "span string, item long, template boolean, words int, names_kept double"
FOUND = "doc_id long, item_id long, words int, names_kept double, kind string"


def word_marks(texts: DataFrame) -> DataFrame:
    """The distinct words of each item but figures, as hashes, and whether each is a name there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                names = names_in(text)
                rows += [(raw_hash(w) - (1 << 64 if raw_hash(w) >> 63 else 0), w in names) for w in set(words_of(text)) if not w[0].isdigit()]
            yield _batch(rows, MARKS)

    return texts.mapInArrow(scan, MARKS)


def item_windows(distinct: DataFrame, templates: Templates) -> DataFrame:
    """Each item's words, which of them are names, and its windows: place, template hash, hash of the fillers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, owner = spelt(text)
                hashes = templates.windows(words).view(np.int64)
                if len(hashes):
                    is_name = "".join("1" if c == NAME else "0" for c in templates.codes(words).tolist())
                    rows.append((item, packed(words, owner), is_name, range(len(hashes)), hashes, fold(templates.raws(words)).view(np.int64)))
            yield _batch(rows, ITEMS)

    return distinct.select("item", "item_text").mapInArrow(scan, ITEMS)


def document_spans(documents: DataFrame, templates: Templates, windows: Bits, reach: int) -> DataFrame:
    """The stretches of documents that may carry an item, `reach` words around included, with their windows that may meet."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = templates.windows(words_of(text))
                hits = np.flatnonzero(windows.known(hashes))
                stretches = dense(hits, reach)
                if not stretches:
                    continue
                words, owner = spelt(text)
                for first, last in stretches:
                    a, b = max(0, first - reach), min(len(words), last + WINDOW + reach)
                    places = hits[(hits >= a) & (hits <= b - WINDOW)]
                    part = packed(words[a:b], owner[a:b])
                    fillers = fold(templates.raws(words[a:b])).view(np.int64)
                    rows.append((doc, xxhash.xxh3_128_hexdigest(part), part, (places - a).astype(np.int32), hashes[places].view(np.int64), fillers[places - a]))
            if rows:
                yield _batch(rows, SPANS)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SPANS)


def _exploded(rows: DataFrame, key: str, place: str, fillers: str) -> DataFrame:
    each = rows.select(key, F.explode(F.arrays_zip("places", "windows", "fillers")).alias("w"))
    return each.select(key, F.col("w.windows").alias("window"), F.col("w.places").alias(place), F.col("w.fillers").alias(fillers))


def template_matches(spans: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """span, item, met (diagonals with the windows whose slots agree), same (their sum), template (see
    `template_only`): the windows of spans and items joined by template hash, the slots of each compared. Only pairs
    that may be of some kind are kept. `few` items' windows are sent to the tasks."""
    theirs, ours = _exploded(items, "item", "pos", "filled"), _exploded(spans, "span", "at", "fillers")
    if few:
        joined = ours.join(F.broadcast(theirs), "window")
    else:
        joined = salted_join(ours.withColumn("by", F.xxhash64("span", "at")), theirs, ["window"], "by")
    agrees = F.col("fillers") == F.col("filled")
    count: list[Column] = [F.count_if(agrees).alias("same"), F.count_if(~agrees).alias("other"), F.min("pos").alias("first"), F.max("pos").alias("last")]
    by_diagonal = joined.groupBy("span", "item", (F.col("at") - F.col("pos")).alias("diagonal")).agg(*count)
    reach = F.col("last") - F.col("first")
    template = (reach + WINDOW >= LEAST_WORDS) & (F.col("other") > F.col("same")) & (2 * (F.col("same") + F.col("other")) >= reach + 1)
    agreeing = F.collect_list(F.when(F.col("same") > 0, F.struct("diagonal", "same"))).alias("met")
    pairs = by_diagonal.groupBy("span", "item").agg(agreeing, F.sum("same").alias("same"), F.bool_or(template).alias("template"))
    return pairs.where((F.col("same") >= LEAST_WINDOWS) | F.col("template"))


def aligned(matches: DataFrame, spans: DataFrame, items: DataFrame) -> DataFrame:
    """The matched pairs with enough agreeing slots, aligned word by word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for span, item, template, met, text, words, is_name in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                found = compared(words, is_name, text, [(m["diagonal"], m["same"]) for m in met])
                rows.append((span, item, template, *(found or (None, None))))
            if rows:
                yield _batch(rows, ALIGNED)

    wanted = matches.where(F.col("same") >= LEAST_WINDOWS).join(spans.select("span", F.col("text").alias("span_text")), "span")
    wanted = salted_join(wanted, items.select("item", F.col("text").alias("words"), "is_name"), ["item"], "span")
    return wanted.select("span", "item", "template", "met", "span_text", "words", "is_name").mapInArrow(scan, ALIGNED)


def leaks(documents: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Every (document, item) that meets: doc_id, item_id, words carried, names_kept, kind (see `kind_of`).

    documents: doc_id, text; items: item_id, item_text. Null or empty texts and items carry nothing; items shorter
    than WINDOW words can't be found; documents and items stored twice give rows for each id, ids repeated give one; a
    text of any length is read whole. Other columns are ignored. The documents are read once, whatever the number of
    items; beyond `broadcast_windows` windows the items are joined by a shuffle, with the same result.
    """
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_text is not null").distinct()
    same_text = F.sha2("item_text", 256)
    members = cut(given.select("item_id", "item_text", same_text.alias("key")))
    distinct = members.groupBy("key").agg(F.min("item_id").alias("item"), F.first("item_text").alias("item_text"))
    marks = word_marks(distinct.select("item_text")).groupBy("word").agg(F.bool_or("name").alias("name"))
    templates = Templates(Bits.of(marks.where("not name"), "word", VOCABULARY_BITS))
    # one item id may stand on several texts: the text's own key is numbered instead
    distinct = distinct.select(F.xxhash64("key").alias("item"), "item_text")
    read = cut(item_windows(distinct, templates))
    size = read.agg(F.sum(F.size("windows")).alias("n"), F.max(F.size("windows")).alias("longest")).first()
    if not size["n"]:
        return documents.sparkSession.createDataFrame([], FOUND)
    windows = Bits.of(read.select(F.explode("windows").alias("window")), "window", FILTER_BITS)
    reach = int((1 + EDITS) * (size["longest"] + WINDOW)) + BAND
    found = cut(document_spans(documents, templates, windows, reach))
    spans = found.dropDuplicates(["span"])
    matches = cut(template_matches(spans, read, size["n"] <= broadcast_windows))
    rest = matches.where(F.col("same") < LEAST_WINDOWS).select("span", "item", "template", F.lit(None).cast("int").alias("words"), F.lit(None).cast("double").alias("names_kept"))
    kind = F.when(F.col("words") >= LEAST_WORDS, "verbatim").when(F.col("template"), "reparameterised").when(F.col("words").isNotNull(), "partial")
    verdicts = aligned(matches, spans, read).unionByName(rest).withColumn("kind", kind).where("kind is not null").na.fill(0, ["words", "names_kept"])
    rank = F.when(F.col("kind") == "verbatim", 3).when(F.col("kind") == "reparameterised", 2).otherwise(1)
    of_documents = found.select("doc_id", "span").distinct().join(verdicts, "span")
    of_items = salted_join(of_documents, members.select("item_id", F.xxhash64("key").alias("item")), ["item"], "doc_id")
    best = of_items.groupBy("doc_id", "item_id").agg(F.max(F.struct(rank.alias("rank"), "words", "names_kept", "kind")).alias("b"))
    return best.select("doc_id", "item_id", "b.words", "b.names_kept", "b.kind")


def search(text: str | None, items: Iterable[tuple[int, str]]) -> list[tuple[int, int, float, str]]:
    """(item id, words carried, share of names kept, kind) for one text, by comparing it with every item: the plain
    statement of what `leaks` finds."""
    given = [(i, *spelt(t), names_in(t)) for i, t in items]
    names = set().union(*(g[3] for g in given))
    known = {raw_hash(w) for _, words, _, _ in given for w in words if w not in names and not w[0].isdigit()}

    class Exact:
        holds = staticmethod(known.__contains__)

    templates = Templates(Exact())
    doc, doc_owner = spelt(text)
    hashes, fillers = templates.windows(doc).tolist(), fold(templates.raws(doc)).tolist()
    out = []
    for i, words, owner, _ in given:
        met: dict[int, list[int]] = {}
        for pos, (h, own) in enumerate(zip(templates.windows(words).tolist(), fold(templates.raws(words)).tolist(), strict=True)):
            for at, other in enumerate(hashes):
                if other == h:
                    m = met.setdefault(at - pos, [0, 0, pos, pos])
                    m[own != fillers[at]] += 1
                    m[3] = pos
        is_name = "".join("1" if c == NAME else "0" for c in templates.codes(words).tolist())
        agreeing = [(d, m[0]) for d, m in met.items() if m[0]]
        carries = compared(packed(words, owner), is_name, packed(doc, doc_owner), agreeing) if agreeing else None
        kind = kind_of(carries and carries[0], any(template_only(*m) for m in met.values()))
        out += [(i, *(carries or (0, 0.0)), kind)] if kind else []
    return out
