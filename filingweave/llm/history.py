"""Deduplicating new batches against all history (problem 5).

Multi-key sorted-neighbourhood runs. Every record gets a canonical identity (issuer, kind of amendment, numbers and
dates of the title, its names, its fixed wording) and from it its sort keys: the issuer with the digits of the
exchange's id, and the issuer with the kind of amendment and the title's figures. A *run* is a sorted list of (sort
key, date, record), persisted in ranges of that order. A batch is merged by reading the ranges its own keys fall into;
only records within one window of a new record are compared: the same sort key and at most `DAYS` from neighbour to
neighbour. The comparison tolerates one slip a word and known abbreviations, but no other figure, name, stage or kind of
amendment. The keys hold nothing a slip may change, and two titles that differ in a key can't be alike, so neighbours
under other keys are never compared and no like pair is missed. Runs are compacted level by level.

Exact repeats of an identity are collapsed before any window is formed, so a group of copies costs one row.
"""

from __future__ import annotations

import datetime
import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingweave.operators.joins import salted_join
from filingweave.session import cut
from filingweave.sources.folders import Commits, Folder

DAYS = 3
DAY_BLOCK = 64
CROWDED = 8  # open titles of a window from which on they are looked up instead of compared one by one
RANGE_ROWS = 500_000  # rows of a key range
LEVEL_ROWS = 10_000  # rows of a run of the lowest level
BROADCAST_KEYS = 100_000  # keys or marks of undated nodes (some 100 bytes each) up to which they are sent to the tasks
LINKS_A_TASK = 1_000_000  # links joined up in one task (some 200 bytes each)
FAN = 8  # runs of a level that are compacted into one of the next

# Months, abbreviations and synonyms of listing titles, and words that mark an amendment.
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
PHRASES = [
    ("fpe", re.compile(r"\bfpe\b"), "financial period ended"),
    ("s/h", re.compile(r"\bs/h\b"), "shareholder"),
    ("holder'", re.compile(r"\bshareholder'?s\b"), "shareholder"),
    ("ga", re.compile(r"^\s*ga\b"), "general announcement"),
    ("rpt", re.compile(r"\brpt\b"), "report"),
]
SYNONYMS = {
    "ann": "announcement", "acqn": "acquisition", "purchase": "acquisition", "issue": "issuance", "pkg": "package", "tr": "tranche",
    "noms": "nominees", "secs": "securities", "dealing": "dealings", "consol": "consolidated", "fin": "financial", "subst": "substantial",
    "qtrly": "quarterly", "disp": "disposal", "corp": "corporation", "chg": "change", "dir": "director", "sale": "disposal",
}
IGNORED = ("number", "sendirian", "berhad")
SMALL = {"sdn", "bhd", *IGNORED, "a", "an", "the", "of", "for", "to", "in", "on", "by", "at", "and", "no", "s", "co", "ref", "pursuant", "with"}
WORDING = sorted(
    """account acquisition additional announcement award back before between board buy centre change changes chief circular company
    consolidated contract court dealings director disposal division dividend ended entitlement extraordinary financial general
    hearing immediate incentive interchange interest interim issuance jalan joint land lease listed listing litigation lot mall
    meeting memorandum mukim new nominees notice office officer operations package period placement principal private proposed
    quarterly registered report resignation results retirement rights scheme securities senior series shareholder shares
    stage substantial suit tenancy termination tower tranche trust under understanding update venture works""".split()
)
AMENDMENTS = {
    "amended announcement": "amended", "amended and restated": "restated", "amendment": "amendment", "corrigendum": "corrigendum",
    "erratum": "erratum", "errata": "erratum", "addendum": "addendum", "supplementary": "supplementary", "revised": "revised", "withdrawal": "withdrawal",
}
AMENDING = {"restated": "restated", "corrigendum": "corrigendum", "amendment": "amendment", "erratum": "erratum", "addendum": "addendum", "supplementary": "supplementary", "amended": "amended"}
_WORDING = set(WORDING)

_STEMS = ("amend", "corrig", "errat", "addend", "restat", "supple", "revis", "withdr")
_TAG = re.compile(r"<[^>]*>")
_YEAR = re.compile(r"\d{4}")
_PREFIX = re.compile(r"^[^:]{3,80}?\b(?:berhad|bhd)\b\.?\s*:\s*", re.I)
_TAIL = re.compile(r"(?:\s*(?:\[[a-z]{2,4}\]|\(re-?listed\)|\(re-?sent\)|-\s*announcement|\.+|…|\*+)\s*)+$", re.I)
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else "may" for m in MONTHS)
_DATES = [
    (re.compile(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"), (1, 2, 3)),
    (re.compile(r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"), (3, 2, 1)),
    (re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?[\s\-]*({_MONTH})[a-z]*[\s\-,]*(\d{{4}})\b"), (3, 2, 1)),
    (re.compile(rf"\b({_MONTH})[a-z]*\s*(\d{{1,2}}),?\s+(\d{{4}})\b"), (3, 1, 2)),
    (re.compile(r"\b(\d{1,2})[\s\-]+([a-z]{3,11})[\s\-]+(\d{4})\b"), (3, 2, 1)),  # a month with a slip
]
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_AMENDED = re.compile(r"[(\-]?\s*\b(" + "|".join(sorted(AMENDMENTS, key=len, reverse=True)) + r")\b\s*(?:to\b|of\b)?\s*[:)]?")


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours makes `a` to `b` (or none)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@lru_cache(maxsize=1 << 16)
def _word(w: str) -> str:
    """The fixed wording a token stands for, or the token itself."""
    w = SYNONYMS.get(w, w)
    if w in _WORDING or w in SMALL or len(w) < 4:
        return w
    near = [x for x in WORDING if len(x) > 3 and within_one(w, x)]
    if near:
        return near[0]
    for short, full in SYNONYMS.items():
        if len(short) > 4 and within_one(w, short):
            return full
    return next((x for x in IGNORED if within_one(w, x)), w)


@lru_cache(maxsize=1 << 16)
def within_two(a: str, b: str) -> bool:
    """Whether two slips of the kinds of `within_one` make `a` to `b` (for words of six letters or more)."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5 or max(len(a), len(b)) < 6:
        return a == b
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1] <= 2


def _month(text: str) -> int:
    if text.isdigit():
        return int(text)
    return next((i for m, i in MONTHS.items() if m.startswith(text[:3])), 0) or next((i for m, i in MONTHS.items() if within_one(text, m) or within_two(text, m)), 0)


@lru_cache(maxsize=1 << 14)
def _amending(word: str) -> str:
    """The amendment a misspelt word stands for, '' for other words."""
    if len(word) < 6:
        return ""
    return next((kind for w, kind in AMENDING.items() if within_one(word, w) or within_two(word, w)), "")


def _dates(text: str) -> tuple[str, list[str]]:
    """The text without its dates, and the dates as yyyymmdd. Impossible dates stay in the text."""
    found: list[str] = []
    for pattern, order in _DATES:

        def take(m: re.Match, order: tuple[int, int, int] = order) -> str:
            try:
                y, mo, d = int(m[order[0]]), _month(m[order[1]]), int(m[order[2]])
                found.append(datetime.date(y, mo, d).strftime("%Y%m%d"))
            except ValueError:
                return m[0]
            return " "

        text = pattern.sub(take, text)
    return text, found


def _trim(text: str) -> str:
    """Without the issuer's name in front and the tags behind."""
    if ":" in text:
        text = _PREFIX.sub("", text)
    return _TAIL.sub("", text) if text and (text[-1] in ".])…*" or text.endswith("announcement")) else text


def canonical_title(title: str | None) -> tuple[str, list[str], list[str], list[str]]:
    """(kind of amendment or '', figures and dates sorted, names in order, wording sorted) of a title."""
    text = (title or "").lower()
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = text.replace("–", "-").replace("—", "-").replace("’", "'")
    text = _trim(" ".join(text.split()))
    kind = ""
    if any(stem in text for stem in _STEMS):
        m = _AMENDED.search(text)
        if m:
            kind = AMENDMENTS[m[1]]
            text = _trim((text[: m.start()] + " " + text[m.end() :]).strip())
    if "," in text:
        text = _THOUSANDS.sub("", text)
    text, figures = _dates(text) if _YEAR.search(text) else (text, [])
    for mark, pattern, to in PHRASES:
        if mark in text:
            text = pattern.sub(to, text)
    names: list[str] = []
    wording: set[str] = set()
    for token in _TOKEN.findall(text):
        if token.isdigit():
            figures.append(token.lstrip("0") or "0")
            continue
        word = _word(token)
        if word in _WORDING:
            wording.add(word)
        elif word not in SMALL:
            names.append(word)
    if not kind:
        slips = [a for a in map(_amending, names) if a]
        if slips:
            kind = "restated" if "restated" in slips else slips[0]
            names = [n for n in names if not _amending(n)]
            if kind == "amended":
                wording.discard("announcement")
    return kind, sorted(figures), names, sorted(wording)


def same_title(a: tuple, b: tuple) -> bool:
    """Whether two canonical titles tell of one filing: the same kind and figures, names alike in their order (one
    slip each, two slips in one of them if the rest is exact), and mostly the same wording."""
    if a[0] != b[0] or a[1] != b[1]:
        return False
    if a == b:
        return True
    missing_a, missing_b = [w for w in b[3] if w not in a[3]], [w for w in a[3] if w not in b[3]]
    names_a, names_b = list(a[2]), list(b[2])
    for names, missing in ((names_a, missing_a), (names_b, missing_b)):  # wording with two slips was taken for a name
        for w in list(missing):
            if len(names_a) == len(names_b):
                break
            slip = next((n for n in names if within_two(n, w)), None)
            if slip is not None:
                names.remove(slip)
                missing.remove(w)
    if len(names_a) != len(names_b) or len(missing_a) + len(missing_b) > 0.4 * (len(a[3]) + len(b[3])):
        return False
    pairs = [(x, y) for x, y in zip(names_a, names_b, strict=True) if x != y]
    if all(within_one(x, y) for x, y in pairs):
        return True
    return len(pairs) == 1 and len(names_a) > 1 and within_two(*pairs[0])


def pack(title: tuple) -> str:
    kind, figures, names, wording = title
    return "\x1f".join((kind, " ".join(figures), " ".join(names), " ".join(wording)))


def unpack(key: str) -> tuple:
    kind, figures, names, wording = key.split("\x1f")
    return kind, figures.split(), names.split(), wording.split()


_COMPANY = re.compile(r'"(?:company|issuer|issuerName|entity|company_name)"\s*:\s*\[?\s*"((?:[^"\\]|\\.)*)"')
_LINKED = re.compile(r"stock_code=[^'\">]*['\"]>([^<]*)<")
_DAY = re.compile(r'"(?:announcement_date|date_announced|annDate|announcedOn|date)"\s*:\s*(?:"([^"]*)"|(\d{12,14}))')
_CELL = re.compile(r">\s*(\d{1,2} [A-Za-z]{3,9} \d{4})\s*<")
_ID = re.compile(r"\d{5,}")


def plain_name(name: str | None) -> str | None:
    return re.sub(r"[^\w]+", " ", name or "").strip().upper() or None


def name_in(raw: str | None) -> str | None:
    """The company a raw record names, keyed or positional, also where the record is cut off behind it."""
    m = _COMPANY.search(raw or "") or _LINKED.search(raw or "")
    return plain_name(m[1]) if m else None


def day_of(announced_at: str | None, raw: str | None) -> int | None:
    """Days since 1970 of the announcement date, from the column or else the raw record."""
    found = _day(announced_at)
    if found is None and raw:
        m = _DAY.search(raw)
        found = _day(m[1] or m[2]) if m else None
        if found is None:
            m = _CELL.search(raw)
            found = _day(m[1]) if m else None
    return found


@lru_cache(maxsize=1 << 14)
def _day(text: str | None) -> int | None:
    if not text:
        return None
    if text.isdigit():
        return int(text) // 86_400_000
    found = _dates(text.lower())[1]
    return (datetime.datetime.strptime(found[0], "%Y%m%d") - datetime.datetime(1970, 1, 1)).days if found else None


def id_digits(bursa_id: str | None, dedup_key: str | None) -> str | None:
    """The digits of the exchange's id however it is written (`ANN-0123`, `ann_id=123`, `123.0`)."""
    text = bursa_id or (dedup_key[6:] if (dedup_key or "").startswith("bursa:") else "")
    m = _ID.search(text or "")
    return (m[0].lstrip("0") or None) if m else None


READ = "id long, batch_no long, company_id long, name string, day int, exchange_id string, title_key string"


def read_filings(filings: DataFrame) -> DataFrame:
    """What identifies each filing: needs id, batch_no, company_id, bursa_announcement_id, dedup_key, title,
    announced_at, raw_json; other columns are ignored.

    Nulls: a null title has no figures, names or wording; without dedup_key and exchange id only the title counts;
    a null date (in the column and in raw_json) never separates.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            names = [name_in(raw) for raw in c["raw_json"]]
            days = [day_of(at, raw) for at, raw in zip(c["announced_at"], c["raw_json"], strict=True)]
            ids = [id_digits(a, b) for a, b in zip(c["bursa_announcement_id"], c["dedup_key"], strict=True)]
            titles = [pack(canonical_title(t)) for t in c["title"]]
            columns = [(c["id"], pa.int64()), (c["batch_no"], pa.int64()), (c["company_id"], pa.int64()), (names, pa.string()), (days, pa.int32()), (ids, pa.string()), (titles, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=[x.split()[0] for x in READ.split(", ")])

    longs, texts = ["id", "batch_no", "company_id"], ["bursa_announcement_id", "dedup_key", "title", "announced_at", "raw_json"]
    return filings.select(*(F.col(x).cast("long").alias(x) for x in longs), *(F.col(x).cast("string").alias(x) for x in texts)).mapInArrow(scan, READ)


ISSUERS = "name string, company_id long, n long"


def issuer_names(read: DataFrame) -> DataFrame:
    """How often a raw record of a company id names which company: name, company_id, n."""
    return read.where("company_id is not null and name is not null").groupBy("name", "company_id").agg(F.count(F.lit(1)).alias("n"))


def identities(read: DataFrame, names: DataFrame) -> DataFrame:
    """id, issuer, day, exchange_id, title_key and the identity (a hash of the four).

    The issuer is the company id; where that is null, the id that records naming the same company mostly have, else
    the name itself. Rows without either have the issuer null and match each other only.
    """
    mostly = names.groupBy("name").agg(F.max_by("company_id", F.struct("n", -F.col("company_id"))).alias("by_name"))
    columns = ["id", "company_id", "name", "day", "exchange_id", "title_key"]
    told = read.where("company_id is not null").select(*columns).withColumn("by_name", F.lit(None).cast("long"))
    untold = read.where("company_id is null").select(*columns)
    untold = salted_join(untold, mostly, ["name"], "id", "left").select(*columns, "by_name")
    return _identified(told.unionByName(untold))


def _identified(rows: DataFrame, *also: str) -> DataFrame:
    issuer = F.coalesce(F.concat(F.lit("#"), F.coalesce("company_id", "by_name").cast("string")), "name")
    return rows.select(
        "id", issuer.alias("issuer"), "day", "exchange_id", "title_key", F.xxhash64(F.coalesce(issuer, F.lit("")), "day", "exchange_id", "title_key").alias("identity"), *also
    )


ASKED = "name string, batch int, by_name long, later int, later_by long"


def names_in_turn(told: DataFrame) -> DataFrame:
    """What a name stands for in each batch that asks: the company id that the records up to that batch mostly give it
    (`by_name`), or where none does, the first `later` batch of which one does and what it stands for then.

    told: name, company_id, batch, n; rows with company_id null ask. Names on file have a batch below all others.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        now, counts, best, asks, waiting = None, {}, None, [], []
        out: list[tuple] = []

        def close() -> None:
            nonlocal asks, waiting
            if best is not None:
                out.extend((at, b, None, now, -best[1]) for b in waiting)
                out.extend((at, b, -best[1], None, None) for b in asks)
                waiting = []
            else:
                waiting += asks
            asks = []

        for batch in batches:
            for name, number, company_id, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != at or number != now:
                    close()
                    if name != at:
                        at, counts, best, waiting = name, {}, None, []
                    now = number
                if company_id is None:
                    asks.append(number)
                else:
                    counts[company_id] = counts.get(company_id, 0) + n
                    held = (counts[company_id], -company_id)
                    best = held if best is None else max(best, held)
            if out:
                yield _answers(out)
                out.clear()
        close()
        if out:
            yield _answers(out)

    return told.select("name", "batch", "company_id", "n").repartition("name").sortWithinPartitions("name", "batch").mapInArrow(scan, ASKED)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ASKED.split(", ")])


def names_on_file(companies: DataFrame) -> DataFrame:
    """The names of a companies table (id, name) as evidence weaker than any record's."""
    return companies.where("name is not null").select(
        F.trim(F.regexp_replace(F.upper("name"), "[^\\w]+", " ")).alias("name"), F.col("id").cast("long").alias("company_id"), F.lit(0).cast("long").alias("n")
    )


def nodes_of(identity_rows: DataFrame) -> DataFrame:
    """Exact repeats of an identity as one node: node (its lowest id), copies, and the identity's parts; of rows with a
    batch also the node's batch and its arrival, the first batch that holds a copy."""
    of_batch = [F.min(F.struct("id", "batch"))["batch"].alias("batch"), F.min("batch").alias("arrival")] if "batch" in identity_rows.columns else []
    return identity_rows.groupBy("identity").agg(
        F.min("id").alias("node"),
        F.count(F.lit(1)).alias("copies"),
        *(F.first(c).alias(c) for c in ("issuer", "day", "exchange_id", "title_key")),
        *of_batch,
    )


END = "\x00"


def run_entries(nodes: DataFrame, *also: str) -> DataFrame:
    """The entries of each node in the sorted runs: rk, node, day, exchange_id, title_key (and other columns of the node).

    A node stands in the run of its exchange id, kind and figures, in which all titles within DAYS are alike and none is
    carried, and in the run of the title's kind and figures, which are equal in all like titles; names may have slips and
    are left to the comparison. The place `rk` in the sort order is the sort key (issuer first) and the stretch of
    DAY_BLOCK days, so that a key's history is cut into ranges; a node of the first DAYS of a stretch stands in the stretch
    before too, so no window is cut. Undated nodes stand before a key's stretches.
    """
    parts = F.split("title_key", "\x1f")
    issuer = F.translate(F.coalesce("issuer", F.lit("")), END, " ")
    stem = F.struct(F.concat_ws("\x1f", issuer, F.lit("t"), parts[0], parts[1]).alias("key"), F.col("title_key"), F.col("exchange_id"))
    none = F.lit(None).cast("string")
    by_id = F.when(F.col("exchange_id").isNotNull(), F.struct(F.concat_ws("\x1f", issuer, F.lit("i"), "exchange_id", parts[0], parts[1]).alias("key"), F.lit("").alias("title_key"), none.alias("exchange_id")))
    block = F.floor(F.col("day") / DAY_BLOCK).cast("int")
    blocks = F.when(F.pmod("day", F.lit(DAY_BLOCK)) <= DAYS, F.array(block - 1, block)).otherwise(F.array(block))
    stretches = F.transform(blocks, lambda b: F.coalesce(F.lpad((b + 1_000_000).cast("string"), 7, "0"), F.lit("")))
    each = nodes.select("node", "day", F.explode(F.array_compact(F.array(by_id, stem))).alias("e"), stretches.alias("stretches"), *also)
    return each.select("e", F.explode("stretches").alias("stretch"), "node", "day", *also).select(F.concat("e.key", F.lit(END), "stretch").alias("rk"), "node", "day", "e.exchange_id", "e.title_key", *also)


ENTRY = ["rk", "day", "node", "exchange_id", "title_key", "is_new"]


LINKS = "id_a long, id_b long"


@lru_cache(maxsize=1 << 16)
def _may_be_wording(name: str) -> bool:
    """Whether `same_title` may take a name for wording with two slips and leave it out."""
    return any(within_two(name, w) for w in WORDING)


def shared(title_key: str, exchange_id: str | None) -> set[str]:
    """Marks of a title; any two alike by `_alike`, of one kind and with the same figures, have one in common.

    The first names are within one slip, so they share a spelling with one letter left out; where they are two slips
    apart all others are exact, the last one too. Names that may be left out as wording are looked past.
    """
    if not title_key:
        return {""}
    names = unpack(title_key)[2]
    marks = set() if exchange_id is None else {"x" + exchange_id}
    for n in names:
        marks.add("f" + n)
        marks.update("f" + n[:i] + n[i + 1 :] for i in range(len(n)))
        if not _may_be_wording(n):
            break
    else:
        marks.add("f")
    for n in reversed(names):
        marks.add("l" + n)
        if not _may_be_wording(n):
            break
    return marks


class Held:
    """The open titles of a run, oldest first: title_key -> (node, day, exchange_id). Where they are crowded only
    those that share a mark with a title are compared with it."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple] = {}
        self.marked: dict[str, dict[str, None]] | None = None

    def put(self, title_key: str, row: tuple) -> None:
        self.drop(title_key)
        self.rows[title_key] = row
        if self.marked is not None:
            self._mark(title_key)

    def drop(self, title_key: str) -> None:
        row = self.rows.pop(title_key, None)
        if row is not None and self.marked is not None:
            for m in shared(title_key, row[2]):
                del self.marked[m][title_key]
                if not self.marked[m]:
                    del self.marked[m]

    def drop_before(self, day: int) -> None:
        while self.rows and self.rows[first := next(iter(self.rows))][1] < day:
            self.drop(first)

    def near(self, title_key: str, exchange_id: str | None) -> list[tuple[str, tuple]]:
        if self.marked is None:
            if len(self.rows) <= CROWDED:
                return list(self.rows.items())
            self.marked = {}
            for other_key in self.rows:
                self._mark(other_key)
        keys = dict.fromkeys(k for m in sorted(shared(title_key, exchange_id)) for k in self.marked.get(m, ()))
        return [(k, self.rows[k]) for k in keys]

    def _mark(self, title_key: str) -> None:
        for m in shared(title_key, self.rows[title_key][2]):
            self.marked.setdefault(m, {})[title_key] = None


def window_links(entries: DataFrame) -> DataFrame:
    """Links between neighbours of sorted runs: entries of one key and at most DAYS apart, one of them new.

    One pass over each sorted partition: of a key's open windows only the last node of each different title is
    held, so equal titles are chained and different ones compared once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        held = Held()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for rk, day, node, exchange_id, title_key, is_new in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rk != at:
                    at, held = rk, Held()
                else:
                    held.drop_before(day - DAYS)
                    for other_key, (other, _, other_exchange, other_new) in held.near(title_key, exchange_id):
                        if (is_new or other_new) and node != other:
                            if other_key == title_key or _alike(title_key, other_key, exchange_id is not None and exchange_id == other_exchange):
                                found.append((min(node, other), max(node, other)))
                held.put(title_key, (node, day, exchange_id, is_new))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["id_a", "id_b"])

    near = Window.partitionBy("rk").orderBy("day").rangeBetween(-DAYS, DAYS)
    return (
        entries.where("day is not null")
        .repartition("rk")
        .withColumn("n", F.count(F.lit(1)).over(near))
        .withColumn("any_new", F.max("is_new").over(near))
        .where("n > 1 and any_new")
        .select(*ENTRY)
        .sortWithinPartitions("rk", "day", "node")
        .mapInArrow(scan, LINKS)
    )


def arrival_links(entries: DataFrame) -> DataFrame:
    """Links of dated entries as their batches arrive (`arrival`): in each key the batches are taken one after the other,
    and each entry is compared with those accepted before it that lie at most DAYS from it, then accepted itself.

    A task holds the stretch of DAY_BLOCK days that it is at: of each day the last node of each different title.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        days: dict[int, Held] = {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            for rk, day, node, exchange_id, title_key in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if rk != at:
                    at, days = rk, {}
                for d in range(day - DAYS, day + DAYS + 1):
                    if d not in days:
                        continue
                    for other_key, (other, _, other_exchange) in days[d].near(title_key, exchange_id):
                        if node != other and (other_key == title_key or _alike(title_key, other_key, exchange_id is not None and exchange_id == other_exchange)):
                            found.append((min(node, other), max(node, other)))
                days.setdefault(day, Held()).put(title_key, (node, day, exchange_id))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["id_a", "id_b"])

    near = Window.partitionBy("rk").orderBy("day").rangeBetween(-DAYS, DAYS)
    return (
        entries.where("day is not null")
        .repartition("rk")
        .withColumn("n", F.count(F.lit(1)).over(near))
        .where("n > 1")
        .select("rk", "day", "node", "exchange_id", "title_key", "arrival")
        .sortWithinPartitions("rk", "arrival", "node")
        .mapInArrow(scan, LINKS)
    )


def _alike(a: str, b: str, one_exchange_id: bool) -> bool:
    x, y = unpack(a), unpack(b)
    return (x[0] == y[0] and x[1] == y[1]) if one_exchange_id else same_title(x, y)


MARKED = "place string, node long, day int, exchange_id string, title_key string, arrival int"
PARTNERS = "node long, other long, later boolean"


def undated_links(entries: DataFrame) -> DataFrame:
    """Links of nodes without any date: to the latest earlier node of a like title in their runs, else to the next.
    `entries`: all of the keys that hold undated nodes. Where they tell their `arrival`, earlier is what was accepted
    before and next is what arrives next; else both go by the ids.

    Like titles share a mark (see `shared`), so a key is split by the marks of its titles, and no task holds a whole one.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rk, day, node, exchange_id, title_key, arrival in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                key = rk[: rk.index(END)]
                rows += [(f"{key}{END}{m}", node, day, exchange_id, title_key, arrival) for m in sorted(shared(title_key, exchange_id))]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MARKED.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, held, waiting = None, None, Held(), Held()
        for batch in batches:
            found: list[tuple[int, int, bool]] = []
            for place, node, day, exchange_id, title_key in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if place != at:
                    at, held, waiting = place, Held(), Held()
                elif node == last:  # it stands in two stretches
                    continue
                last = node
                like = lambda near: [x for k, x in near if k == title_key or _alike(title_key, k, exchange_id is not None and exchange_id == x[2])]  # noqa: B023, E731
                for x in like(waiting.near(title_key, exchange_id)):
                    found.append((x[0], node, True))
                    waiting.drop(x[3])
                row = (node, day, exchange_id, title_key)
                if day is None:
                    earlier = max((x[0] for x in like(held.near(title_key, exchange_id))), default=None)
                    if earlier is None:
                        waiting.put(title_key, row)
                    else:
                        found.append((node, earlier, False))
                held.put(title_key, row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=[x.split()[0] for x in PARTNERS.split(", ")])

    arrival = F.col("arrival") if "arrival" in entries.columns else F.lit(0).alias("arrival")
    marks = entries.select("rk", "day", "node", "exchange_id", "title_key", arrival)
    asked = cut(marks.where("day is null").mapInArrow(marked, MARKED).select("place").distinct())
    if asked.count() <= BROADCAST_KEYS:
        asked = F.broadcast(asked)
    partners = (
        marks.mapInArrow(marked, MARKED)
        .join(asked, "place", "left_semi")
        .repartition("place")
        .sortWithinPartitions("place", "arrival", "node")
        .mapInArrow(scan, PARTNERS)
    )
    one = partners.groupBy("node").agg(F.coalesce(F.max(F.when(~F.col("later"), F.col("other"))), F.min(F.when(F.col("later"), F.col("other")))).alias("other"))
    return one.select(F.least("node", "other").alias("id_a"), F.greatest("node", "other").alias("id_b"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as links of each node with the lowest one it is joined to there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["id_a", "id_b"])


def roots(links: DataFrame, lot: int = LINKS_A_TASK) -> DataFrame:
    """node -> root (the lowest node of its component), for all linked nodes.

    Lots of at most about `lot` links are joined up within tasks; where there is more than one lot, rounds of hooking
    and pointer jumping join the lots, each round written to the shared folder, until nothing changes.
    """
    links = cut(links)
    lots = max(1, -(-links.count() // lot))
    stars = (links.repartition(lots) if lots > 1 else links.coalesce(1)).mapInArrow(_stars, LINKS)
    if lots == 1:
        return cut(stars.select(F.col("id_b").alias("node"), F.col("id_a").alias("root")))
    links = cut(stars.distinct())
    both = links.select(F.col("id_a").alias("node"), F.col("id_b").alias("near")).unionByName(links.select(F.col("id_b").alias("node"), F.col("id_a").alias("near")))
    label = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root"))
    while True:
        near = both.join(label.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("by_near"))
        jump = label.join(label.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
        new = cut(jump.join(near, "node").select("node", F.least("root", "further", "by_near").alias("new"), F.col("root").alias("old")))
        label = new.select("node", F.col("new").alias("root"))
        if new.where("new <> old").isEmpty():
            return label


NO_DAY = -(1 << 31)


def anchored(states: DataFrame) -> DataFrame:
    """comp, day -> root, with filings cut so that each lies within DAYS of its own first row. states: comp (the
    lowest id of linked rows), day (NO_DAY where there is none), first (the lowest id of that day).

    Going up the ids, a day joins the lowest anchor within DAYS of it, else its first row is an anchor itself; rows
    without a date join the first, as does the first day behind them. All rows of a day go with its first, so copies
    cost nothing here. One pass over the sorted days; what is held of a filing is an id for each anchor.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors = None, {}
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for comp, day, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if comp != at:
                    at, anchors = comp, {}
                if day == NO_DAY:
                    out.append((comp, day, comp))
                    continue
                near = [anchors[d] for d in range(day - DAYS, day + DAYS + 1) if d in anchors]
                target = min(near, default=first if anchors else comp)
                out.append((comp, day, target))
                if not near:
                    anchors[day] = target
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["comp", "day", "root"])

    return states.select("comp", "day", "first").repartition("comp").sortWithinPartitions("comp", "first").mapInArrow(scan, "comp long, day int, root long")


def _repeats(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(id_a, id_b) of the rows (id, comp, day) that aren't the first of their filing. The lowest row of linked ones is
    always a first, and only filings with other rows are looked at."""
    rows = rows.where("id <> comp")
    several = states.join(rows.select("comp").distinct(), "comp", "left_semi")
    return salted_join(rows, anchored(several), ["comp", "day"], "id").where("id <> root").select(F.col("root").alias("id_a"), F.col("id").alias("id_b")).distinct()


def link_all(filings: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """All repeats of a table of filings, as one bulk run: id_a (first row of the filing), id_b. The plain statement of
    what `Runs` finds batch by batch."""
    read = cut(read_filings(filings))
    names = issuer_names(read)
    rows = identities(read, names if companies is None else names.unionByName(names_on_file(companies)))
    nodes = cut(nodes_of(rows))
    entries = run_entries(nodes).withColumn("is_new", F.lit(True))
    label = roots(window_links(entries).unionByName(undated_links(_of_undated_keys(entries))))
    placed = nodes.join(label, "node", "left").select("identity", F.coalesce("root", "node").alias("comp"), F.coalesce("day", F.lit(NO_DAY)).alias("day"), "node")
    states = placed.groupBy("comp", "day").agg(F.min("node").alias("first"))
    return _repeats(salted_join(rows.select("id", "identity"), placed.drop("node"), ["identity"], "id").select("id", "comp", "day"), states)


def _of_undated_keys(entries: DataFrame) -> DataFrame:
    """All entries of the keys that hold an undated node."""
    key = F.substring_index("rk", END, 1)
    keys = cut(entries.where("day is null").select(key.alias("key")).distinct())
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return entries.withColumn("key", key).join(keys, "key", "left_semi").drop("key")


def _comp_key(comp: str = "comp") -> Column:
    return F.lpad(F.col(comp).cast("string"), 20, "0")


class Runs:
    """Sorted runs of the accepted history in a shared folder, in ranges of the sort order.

    Six kinds of rows are kept, each sorted by its place `rk` and cut into files of about `range_rows` rows; the current
    commit names the live runs and, for every file, the first and the last place in it:
    `entries` and `undated` (the sorted runs; rk by issuer, sort key and days), `names` (how often which company id goes
    with a name; rk by name), `states` (the days of a filing and the first row of each; rk by filing), `merges` (what a
    node, or a `whole` filing accepted before, was found to belong to; rk by it), `rows` (the other rows; rk by filing).

    A batch reads the files whose range holds one of its own keys and no others, so its work follows its own size and not
    that of the history. A run is written whole before a commit names it. `fan` runs of a level are compacted into one of
    the next, and files no commit names are removed.
    """

    KINDS = {
        "entries": "rk string, day int, node long, exchange_id string, title_key string",
        "undated": "rk string, day int, node long, exchange_id string, title_key string",
        "names": "rk string, name string, company_id long, n long",
        "states": "rk string, comp long, day int, first long, batch int",
        "merges": "rk string, comp long, into long, whole boolean",
        "rows": "rk string, id long, comp long, day int, batch int",
    }

    def __init__(self, spark: SparkSession, folder: str, range_rows: int = RANGE_ROWS, fan: int = FAN) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)
        self.commits = Commits(self.folder, {"runs": [], "batches": {}, "next": 1})
        self.range_rows, self.fan = range_rows, fan

    # files

    def _files(self, state: dict, kind: str) -> list[list]:
        return [f for run in state["runs"] for f in run["files"].get(kind, [])]

    def _read(self, kind: str, files: list[list]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.KINDS[kind])
        return self.spark.read.schema(self.KINDS[kind]).parquet(*(f"{self.folder.path}/{f[0]}" for f in files))

    def _touched(self, state: dict, kind: str, places: DataFrame) -> DataFrame:
        """The rows of the files whose range holds a place or stretch of places (first, last). Of the batch only which
        files it touches comes to the driver."""
        files = self._files(state, kind)
        bounded = [i for i, f in enumerate(files) if f[1] is not None]
        if not bounded:
            return self._read(kind, files)
        order = sorted(bounded, key=lambda i: (files[i][0].rpartition("/")[0], files[i][1]))
        runs = [list(g) for _, g in groupby(order, key=lambda i: files[i][0].rpartition("/")[0])]
        bounds = [(r, [files[i][1] for i in r], [files[i][2] for i in r]) for r in runs]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hit: set[int] = set()
            for batch in batches:
                for first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for r, lows, highs in bounds:
                        hit.update(r[bisect_left(highs, first) : bisect_right(lows, last)])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hit), pa.int32())], names=["at"])

        wanted = {r["at"] for r in places.select("first", "last").mapInArrow(scan, "at int").distinct().collect()}
        return self._read(kind, [f for i, f in enumerate(files) if f[1] is None or i in wanted])

    def _write(self, run: int, kind: str, rows: DataFrame, count: int) -> list[list]:
        """Write sorted ranges of about `range_rows` rows; [file, first place, last place] of each."""
        if not count:
            return []
        name = f"{kind}/run={run}"
        ranges = -(-count // self.range_rows)
        spread = rows.repartitionByRange(ranges, "rk") if ranges > 1 else rows.coalesce(1)
        spread.sortWithinPartitions("rk").write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        if ranges == 1:  # one file of a bounded size is read without asking
            return [[name, None, None]]
        bounds = self.spark.read.parquet(f"{self.folder.path}/{name}").groupBy(F.input_file_name().alias("file")).agg(F.min("rk").alias("first"), F.max("rk").alias("last"))
        return sorted([f"{name}/{r['file'].rpartition('/')[2]}", r["first"], r["last"]] for r in bounds.collect())

    def _commit(self, state: dict, base: int, dead: list[dict] = []) -> dict:  # noqa: B006
        state = self.commits.put(state, base)
        for run in dead:
            for kind in run["files"]:
                self.folder.remove(f"{kind}/run={run['n']}")
        return state

    # batches

    def add(self, batch: DataFrame, companies: DataFrame | None = None, name: str | None = None) -> DataFrame:
        """Check a batch against all accepted rows, accept it, and return its repeats (id_a, id_b).

        A batch whose `name` was accepted before changes nothing and has its repeats told again. What marks a row as new
        is that it is in the batch, not its id.
        """
        state = self.commits.current()
        if name is not None and name in state["batches"]:
            return self.repeats(state["batches"][name])
        run, state = self._accept(state, batch, companies, name)
        here = {**state, "runs": [r for r in state["runs"] if r["n"] == run]}
        found = cut(_repeats(self._rows(here, run), self._read("states", self._files(here, "states"))))
        self._compact_levels(state)
        return found

    def accept(self, batch: DataFrame, companies: DataFrame | None = None, name: str | None = None) -> None:
        """Accept a batch as `add` does, without telling its repeats."""
        state = self.commits.current()
        if name is None or name not in state["batches"]:
            self._compact_levels(self._accept(state, batch, companies, name)[1])

    def _rows(self, state: dict, batch: int | None = None) -> DataFrame:
        """id, comp and day of all rows, or of those of a batch: the first of each day stands in `states`."""
        firsts = self._read("states", self._files(state, "states")).select(F.col("first").alias("id"), "comp", "day", "batch")
        rows = self._read("rows", self._files(state, "rows")).select("id", "comp", "day", "batch").unionByName(firsts)
        return rows if batch is None else rows.where(F.col("batch") == batch)

    def _accept(self, state: dict, batch: DataFrame, companies: DataFrame | None, name: str | None) -> tuple[int, dict]:
        run, begun = state["next"], bool(state["runs"])
        read = cut(read_filings(batch))
        told = cut(read.where("name is not null").groupBy("name", "company_id").agg(F.count(F.lit(1)).alias("n")))
        learnt = told.where("company_id is not null")
        names, first_told = self._names(state, told, companies)
        rows = identities(read, names).withColumn("batch", F.lit(run))
        nodes = cut(nodes_of(rows))
        fresh = run_entries(nodes)
        if begun and not first_told.isEmpty():
            fresh = fresh.unionByName(cut(self._renamed(state, first_told, names)))
        after = self._store(state, rows, nodes, fresh, self._links(state, fresh), learnt, run + 1, {} if name is None else {name: run})
        return run, after

    def _store(self, state: dict, rows: DataFrame, nodes: DataFrame, fresh: DataFrame, links: DataFrame, learnt: DataFrame, after: int, batches: dict[str, int]) -> dict:
        """Write what was accepted as the next run and commit it; `after`: the number of the run behind it."""
        run, begun = state["next"], bool(state["runs"])
        label = roots(links).withColumnRenamed("node", "comp")
        placed = cut(
            nodes.select("identity", "node", "copies", "batch", F.coalesce("day", F.lit(NO_DAY)).alias("day"))
            .join(label.withColumnRenamed("comp", "node"), "node", "left")
            .select("identity", "node", "copies", "batch", "day", F.coalesce("root", "node").alias("comp"))
        )
        by_comp = _comp_key().alias("rk")
        states = placed.select("comp", "day", F.struct(F.col("node").alias("first"), "batch").alias("of"))
        if begun:
            held = self._touched(state, "states", label.select(_comp_key().alias("first"), _comp_key().alias("last")))
            held = cut(held.join(label, "comp").select("comp", "root", "day", F.struct("first", "batch").alias("of")))
            states = states.unionByName(held.select(F.col("root").alias("comp"), "day", "of"))
        states = states.groupBy("comp", "day").agg(F.min("of").alias("of")).select(by_comp, "comp", "day", "of.first", "of.batch")
        merges, whole = placed.where("node <> comp").select(F.col("node").alias("comp"), F.col("comp").alias("into"), F.lit(False).alias("whole")), 0
        if begun:
            joined = held.where("comp <> root").select("comp", F.col("root").alias("into"), F.lit(True).alias("whole")).distinct()
            merges, whole = merges.unionByName(joined), joined.count()
        copies = salted_join(rows.select("id", "identity", "batch"), placed.where("copies > 1").select("identity", "node", "comp", "day"), ["identity"], "id").where("id <> node").select("id", "comp", "day", "batch")
        others = copies.unionByName(placed.where("node <> comp").select(F.col("node").alias("id"), "comp", "day", "batch")).distinct()
        count = placed.agg(F.count(F.lit(1)).alias("nodes"), F.sum("copies").alias("rows"), F.count_if(F.col("day") == NO_DAY).alias("undated"), F.count_if((F.col("copies") > 1) | (F.col("node") != F.col("comp"))).alias("other")).first()
        columns = ["rk", "day", "node", "exchange_id", "title_key"]
        files = {
            "entries": self._write(run, "entries", fresh.where("day is not null").select(*columns), 2 * count["nodes"]),
            "undated": self._write(run, "undated", fresh.where("day is null").select(*columns), 2 * count["undated"]),
            "names": self._write(run, "names", learnt.select(F.col("name").alias("rk"), "*"), count["nodes"]),
            "states": self._write(run, "states", states, count["nodes"]),
            "merges": self._write(run, "merges", merges.select(by_comp, "*"), count["other"] + whole),
            "rows": self._write(run, "rows", others.select(by_comp, "*"), (count["rows"] or 0) - count["nodes"] + count["other"]),
        }
        written = {"n": run, "size": count["rows"] or 0, "whole": whole, "files": files}
        return self._commit({**state, "runs": [*state["runs"], written], "batches": {**state["batches"], **batches}, "next": after}, state["commit"])

    def accept_each(self, filings: DataFrame, companies: DataFrame | None = None) -> None:
        """Accept the batches of a table one after the other, each checked against all accepted before it and named by
        its batch_no (rows without one come first, unnamed).

        What one `accept` a batch would find, found range by range: a task takes the batches of its ranges in turn, so that a
        batch costs its rows and not a round of jobs. All batches become one run. Where runs are there
        already, each batch is accepted by itself.
        """
        state = self.commits.current()
        numbers = [r["batch_no"] for r in filings.select(F.col("batch_no").cast("long").alias("batch_no")).distinct().orderBy("batch_no").collect()]
        if state["runs"]:
            for b in numbers:
                self.accept(filings.where(F.col("batch_no").cast("long").eqNullSafe(F.lit(b))), companies, None if b is None else str(b))
            return
        run = state["next"]
        order = self.spark.createDataFrame([(b, run + i) for i, b in enumerate(numbers)], "number long, batch int")
        read = read_filings(filings)
        read = cut(read.join(F.broadcast(order), read["batch_no"].eqNullSafe(order["number"])).drop("number"))
        told = cut(read.where("name is not null").groupBy("name", "company_id", "batch").agg(F.count(F.lit(1)).alias("n")))
        learnt = told.where("company_id is not null").groupBy("name", "company_id").agg(F.sum("n").alias("n"))
        known = told
        if companies is not None:
            known = known.unionByName(names_on_file(companies).where("company_id is not null").withColumn("batch", F.lit(-1)).join(told.where("company_id is null").select("name").distinct(), "name", "left_semi"))
        asked = cut(names_in_turn(known))
        columns = ["id", "company_id", "name", "day", "exchange_id", "title_key", "batch"]
        answers = {"by_name": "long", "later": "int", "later_by": "long"}
        direct = read.where("company_id is not null").select(*columns, *(F.lit(None).cast(t).alias(c) for c, t in answers.items()))
        untold = salted_join(read.where("company_id is null").select(*columns), asked, ["name", "batch"], "id", "left").select(*columns, *answers)
        rows = _identified(direct.unionByName(untold), "batch", "later", "later_by")
        nodes = cut(nodes_of(rows))
        arriving = nodes.select("node", "issuer", "day", "exchange_id", "title_key", "arrival")
        if not asked.where("later is not null").isEmpty():  # what came under a mere name comes once more with the first record that tells its company
            renamed = rows.where("later is not null").select("identity", F.col("later").alias("arrival"), F.concat(F.lit("#"), F.col("later_by").cast("string")).alias("issuer")).distinct()
            arriving = arriving.unionByName(nodes.drop("issuer", "arrival").join(renamed, "identity").select(*arriving.columns))
        fresh = run_entries(arriving, "arrival")
        links = arrival_links(fresh).unionByName(undated_links(_of_undated_keys(fresh)))
        self._store(state, rows.drop("later", "later_by"), nodes, fresh, links, learnt, run + max(1, len(numbers)), {str(b): run + i for i, b in enumerate(numbers) if b is not None})

    def _names(self, state: dict, told: DataFrame, companies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """How often a name that the batch holds goes with which company id, by batch, history and table; and the names
        whose company id a record tells here for the first time."""
        names = told.where("company_id is not null")
        first_told = names.select("name").distinct()
        if companies is not None:
            names = names.unionByName(names_on_file(companies))
        if state["runs"]:
            asked = told.select("name").distinct()
            held = cut(self._touched(state, "names", asked.select(F.col("name").alias("first"), F.col("name").alias("last"))).join(asked, "name", "left_semi").select("name", "company_id", "n"))
            names, first_told = names.unionByName(held), cut(first_told.join(held.select("name"), "name", "left_anti"))
        return cut(names.groupBy("name", "company_id").agg(F.sum("n").alias("n"))), first_told

    def _renamed(self, state: dict, first_told: DataFrame, names: DataFrame) -> DataFrame:
        """The entries that were accepted under a mere name, once more under the company id that the name stands for now."""
        places = first_told.select(F.concat("name", F.lit("\x1f")).alias("first"), F.concat("name", F.lit(" ")).alias("last"))
        old = self._touched(state, "entries", places).unionByName(self._touched(state, "undated", places))
        mostly = names.groupBy("name").agg(F.max_by("company_id", F.struct("n", -F.col("company_id"))).alias("company_id")).join(first_told, "name")
        of_name = old.withColumn("name", F.substring_index("rk", "\x1f", 1)).join(mostly, "name")
        return of_name.withColumn("rk", F.concat(F.lit("#"), F.col("company_id").cast("string"), F.expr("substring(rk, length(name) + 1)"))).select("rk", "node", "day", "exchange_id", "title_key")

    def _links(self, state: dict, fresh: DataFrame) -> DataFrame:
        """Links among the batch's filings and those of the history, all by what their nodes belong to now."""
        key = F.substring_index("rk", END, 1)
        around = fresh.where("day is not null").withColumn("is_new", F.lit(True))
        without = fresh.where("day is null").select(key.alias("key"))
        if state["runs"]:
            places = fresh.select(F.col("rk").alias("first"), F.col("rk").alias("last"))
            around = around.unionByName(self._touched(state, "entries", places).withColumn("is_new", F.lit(False)))
            if self._files(state, "undated"):
                keys = fresh.select(key.alias("key")).distinct()
                start = F.concat("key", F.lit(END))
                waiting = self._touched(state, "undated", keys.select(start.alias("first"), start.alias("last")))
                without = without.unionByName(waiting.select(key.alias("key")).join(keys, "key", "left_semi"))
        links, without = window_links(around), cut(without.distinct())
        keys_without = without.count()
        if keys_without:
            if keys_without <= BROADCAST_KEYS:
                without = F.broadcast(without)
            whole = fresh
            if state["runs"]:
                places = without.select(F.concat("key", F.lit(END)).alias("first"), F.concat("key", F.lit("\x01")).alias("last"))
                whole = fresh.unionByName(self._touched(state, "entries", places)).unionByName(self._touched(state, "undated", places))
            links = links.unionByName(undated_links(whole.withColumn("key", key).join(without, "key", "left_semi").drop("key")))
        return self._present(state, cut(links)) if self._files(state, "merges") else links

    def _present(self, state: dict, links: DataFrame) -> DataFrame:
        """Links by the filings that their nodes belong to now."""
        names = cut(links.select(F.explode(F.array("id_a", "id_b")).alias("comp")).distinct().withColumn("at", F.col("comp")))
        while True:
            known = names.select(_comp_key("at").alias("first"), _comp_key("at").alias("last"))
            into = self._touched(state, "merges", known).groupBy(F.col("comp").alias("at")).agg(F.min("into").alias("into"))
            told = cut(names.join(into, "at", "left").select("comp", F.coalesce("into", "at").alias("at"), F.col("into").isNotNull().alias("moved")))
            names = told.select("comp", "at")
            if not any(run["whole"] for run in state["runs"]) or told.where("moved").isEmpty():
                break
        both = links.join(names.select(F.col("comp").alias("id_a"), F.col("at").alias("a")), "id_a").join(names.select(F.col("comp").alias("id_b"), F.col("at").alias("b")), "id_b")
        # a link within one filing still names it, so that its days are read
        return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))

    def repeats(self, batch: int | None = None) -> DataFrame:
        """(id_a, id_b) of all accepted rows, or of those of one run, as of the last commit."""
        state = self.commits.current()
        rows, states = self._rows(state, batch), self._read("states", self._files(state, "states"))
        if any(run["whole"] for run in state["runs"]):
            merges = self._read("merges", self._files(state, "merges")).where("whole")
            label = roots(merges.select(F.least("comp", "into").alias("id_a"), F.greatest("comp", "into").alias("id_b"))).withColumnRenamed("node", "comp")
            present = lambda df, by: salted_join(df, label.where("comp <> root"), ["comp"], by, "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
            rows, states = present(rows, "id"), present(states, "first")
        return _repeats(rows, states.groupBy("comp", "day").agg(F.min("first").alias("first")))

    # compaction

    def _level(self, run: dict) -> int:
        level, size = 0, min(LEVEL_ROWS, self.range_rows)
        while run["size"] > size:
            level, size = level + 1, size * self.fan
        return level

    def _compact_levels(self, state: dict) -> None:
        while True:
            by_level: dict[int, list[dict]] = {}
            for run in state["runs"]:
                by_level.setdefault(self._level(run), []).append(run)
            crowded = next((runs for _, runs in sorted(by_level.items()) if len(runs) >= self.fan), None)
            if crowded is None:
                return
            state = self._merge(state, crowded)

    def compact(self) -> None:
        """Merge all live runs into one."""
        state = self.commits.current()
        if len(state["runs"]) > 1:
            self._merge(state, state["runs"])

    def _merge(self, state: dict, runs: list[dict]) -> dict:
        """One run in place of several: equal entries of a filing become one, the names' counts are added up."""
        n, files = state["next"], {}
        part = {**state, "runs": runs}
        alike = {
            "entries": (["rk", "day", "exchange_id", "title_key"], [F.min("node").alias("node")]),
            "undated": (["rk", "day", "exchange_id", "title_key"], [F.min("node").alias("node")]),
            "names": (["rk", "name", "company_id"], [F.sum("n").alias("n")]),
            "states": (["rk", "comp", "day"], [F.min("first").alias("first"), F.min_by("batch", "first").alias("batch")]),
            "merges": (["rk", "comp"], [F.min("into").alias("into"), F.max("whole").alias("whole")]),
            "rows": (["rk", "id", "comp", "day", "batch"], []),
        }
        for kind, (keys, aggregates) in alike.items():
            if self._files(part, kind):
                rows = self._read(kind, self._files(part, kind))
                merged = rows.groupBy(*keys).agg(*aggregates) if aggregates else rows.select(*keys).distinct()
                files[kind] = self._write(n, kind, merged.select(*(c.split()[0] for c in self.KINDS[kind].split(", "))), max(rows.count(), 1))
        gone = {r["n"] for r in runs}
        run = {"n": n, "size": sum(r["size"] for r in runs), "whole": sum(r["whole"] for r in runs), "files": files}
        return self._commit({**state, "runs": [*(r for r in state["runs"] if r["n"] not in gone), run], "next": n + 1}, state["commit"], runs)


def repeats_by_batch(spark: SparkSession, filings: DataFrame, companies: DataFrame | None, folder: str, lots: int | None = None) -> DataFrame:
    """All repeats of a table of filings, each of its batches accepted by `Runs` for itself and in order (rows without a
    batch come first). Only a caller that asks for it has them accepted in `lots` of batches. The runs are removed
    afterwards."""
    runs = Runs(spark, folder)
    if lots is None:
        runs.accept_each(filings, companies)
    else:
        ends = filings.agg(F.min("batch_no"), F.max("batch_no")).first()
        low, high = (0, 0) if ends[0] is None else (int(ends[0]), int(ends[1]))
        lots = min(lots, high - low + 1)
        starts = [low + -(-k * (high - low + 1) // lots) for k in range(lots + 1)]
        for k in range(lots):
            lot = F.col("batch_no").between(starts[k], starts[k + 1] - 1)
            runs.accept(filings.where(lot if k else lot | F.col("batch_no").isNull()), companies)
    found = cut(runs.repeats())
    runs.folder.remove()
    return found
