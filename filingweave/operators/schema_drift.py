"""Schemas that drift between files (problem 4).

1. *Headers in parallel*: every raw record is parsed once where it lies; what leaves a task is one row per
   (file, key, JSON type) with a count, plus a hashed profile of each key's content (`PROFILE` buckets), so the
   shuffle carries headers, not records.
2. *Fold*: the files of a feed are folded in order through the type lattice (below). A feed may hold a third of
   all files, so files are folded in blocks of `BLOCK`: each block is first reduced to a summary (a monoid:
   last layout, with types still open where no record of the block told one and no file lacked the key), the summaries of a feed are
   folded, and each block is then replayed from the layout that reaches it.
3. *Differences*: keys that vanish and appear in the same step are paired when their contents are of one kind
   (cosine of the profiles, or the same name up to case and separators), each key at most once.
4. *One table*: `unified_schema` promotes the types of every lineage of renamed keys; `Unifier` casts records.

The lattice of JSON types: null < every type; boolean, number and string promote to string; an object or an
array with anything else promotes to string (its JSON text).
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingweave.session import cut

BLOCK = 1024
PROFILE = 512
SAME_KIND = 0.5
ROOT = "$"

_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array", type(None): "null"}
_WORD = re.compile(r"[^\W\d_]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
#: Escapes of half a surrogate pair, which no string may hold.
_LONE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}")


def json_type(value: object) -> str:
    return _TYPES[type(value)]


def promote(left: str | None, right: str | None) -> str | None:
    """The least upper bound of two JSON types; None or 'null' is the bottom."""
    if left in (None, "null"):
        return right
    if right in (None, "null") or left == right:
        return left
    return "string"


def _leaves(value: object) -> Iterator[str]:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif x is not None:
            yield x if isinstance(x, str) else str(x)


def _features(leaf: str) -> list[str]:
    """What a value tells of its kind: its words in lower case; a short value with digits by its whole shape
    (`31 Dec 2023` is `99 a 9999`), a longer one by the length of each run of digits."""
    words = _WORD.findall(leaf)
    out = [w.lower() for w in words if not w[0].isdigit()]
    if len(out) < len(words):
        if len(words) <= 3:
            out.append(_LETTERS.sub("a", _DIGIT.sub("9", leaf.strip())))
        else:
            out.extend("9" * len(w) for w in words if w[0].isdigit())
    return out


def _buckets(leaf: str, seen: dict[str, list[int]]) -> list[int]:
    """The profile buckets of a value's features."""
    at = seen.get(leaf)
    if at is None:
        at = [zlib.crc32(x.encode()) % PROFILE for x in _features(leaf)]
        if len(leaf) <= 64 and len(seen) < 1 << 15:  # a memo of computed values
            seen[leaf] = at
    return at


def _records(payload: object, wrapped: bool) -> tuple[str | None, list[dict]]:
    """The top-level key (for wrapped payloads) and the keyed records; ([], None) where there are none."""
    if not wrapped:
        return None, [payload] if isinstance(payload, dict) else []
    if isinstance(payload, dict):
        for key, value in payload.items():
            if isinstance(value, list):
                return key, [x for x in value if isinstance(x, dict)]
    return None, []


def parse(text: object) -> object:
    """The JSON value, or None where the text is null, empty, cut off or otherwise unreadable."""
    if not isinstance(text, str) or not text:
        return None
    if "\\u" in text:
        text = _LONE.sub(r"\\ufffd", text)
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


HEADERS = "table_name string, feed string, file_no long, field string, kind string, bucket int, n long"


def headers(raw: DataFrame, wrapped: bool) -> DataFrame:
    """Header rows of raw records: `raw` has table_name, feed, file_no, body (JSON text).

    kind is a JSON type (then bucket is null and n counts records of the file with it), or `profile <type>` (then n
    counts features of the field's values of that type in the bucket, over all files of the table; feed and file_no
    are null), or `top` (bucket -1: the key is the top-level one of n payloads). Summed over all records.
    The top-level key of a wrapped payload is a field of its own, of type array.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: Counter = Counter()
        words: Counter = Counter()
        seen: dict[str, list[int]] = {}
        for batch in batches:
            cols = [batch.column(name).to_pylist() for name in ("table_name", "feed", "file_no", "body")]
            for table_name, feed, file_no, body in zip(*cols, strict=True):
                top, rows = _records(parse(body), wrapped)
                if not rows:
                    continue
                where = (table_name, feed, file_no)
                if top is not None:
                    types[(*where, top, "array")] += 1
                    words[(table_name, top, "top", -1)] += 1
                    words[(table_name, top, "array", zlib.crc32(b"list of records") % PROFILE)] += len(rows)
                for row in rows:
                    for key, value in row.items():
                        kind = json_type(value)
                        types[(*where, key, kind)] += 1
                        for leaf in _leaves(value):
                            for at in _buckets(leaf, seen):
                                words[(table_name, key, kind, at)] += 1
            if len(types) + len(words) > 200_000:
                yield from _flush(types, words)
        yield from _flush(types, words)

    return (
        raw.select("table_name", "feed", F.col("file_no").cast("long").alias("file_no"), F.col("body").cast("string").alias("body"))
        .where("file_no is not null")
        .mapInArrow(scan, HEADERS)
        .groupBy("table_name", "feed", "file_no", "field", "kind", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def _flush(types: Counter, words: Counter) -> Iterator[pa.RecordBatch]:
    rows = [(*k[:3], k[3], k[4], None, n) for k, n in types.items()] + [(t, None, None, k, kind if b < 0 else f"profile {kind}", b, n) for (t, k, kind, b), n in words.items()]
    types.clear()
    words.clear()
    if rows:
        names = ["table_name", "feed", "file_no", "field", "kind", "bucket", "n"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _told(kinds: list[str]) -> str:
    """A file's type of a key: the sorted types its records tell, '' where all are null."""
    return "|".join(sorted({k for k in kinds if k != "null"}))


def _layouts(pdf: pd.DataFrame) -> Iterator[tuple[int, dict[str, str]]]:
    ordered = pdf.sort_values("file_no", kind="stable")
    for file_no, fields in zip(ordered["file_no"], ordered["fields"], strict=True):
        kinds: dict[str, list[str]] = {}
        for x in fields:
            kinds.setdefault(x["field"], []).append(x["kind"])
        yield int(file_no), {k: _told(v) for k, v in kinds.items()}


def step(before: dict[str, str] | None, own: dict[str, str]) -> dict[str, str]:
    """The layout after a file: its own keys; a type it doesn't tell is carried on from the layout before."""
    before = before or {}
    return {k: t or before.get(k, "") for k, t in own.items()}


def _summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """The block's last layout: key -> [type, whether a type that is still open is that of the layout before the block],
    which holds only for keys that no file of the block lacks."""
    state: dict[str, tuple[str, bool]] | None = None
    for _, own in _layouts(pdf):
        before = state
        state = {k: (t, False) if t else ("", True) if before is None else before.get(k, ("", False)) for k, t in own.items()}
    first = pdf.iloc[0]
    return pd.DataFrame([[first["table_name"], first["feed"], first["block"], json.dumps(state)]], columns=["table_name", "feed", "block", "layout"])


def _reach(pdf: pd.DataFrame) -> pd.DataFrame:
    state: dict[str, str] | None = None
    rows = []
    for r in pdf.sort_values("block").itertuples():
        rows.append([r.table_name, r.feed, r.block, json.dumps(state)])
        before = state or {}
        state = {k: t or (before.get(k, "") if inherits else "") for k, (t, inherits) in json.loads(r.layout).items()}
    return pd.DataFrame(rows, columns=["table_name", "feed", "block", "incoming"])


STEPS = "table_name string, feed string, file_no long, change_kind string, field_name string, old_type string, new_type string"


def _replay(key: tuple, files: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
    columns = [c.split()[0] for c in STEPS.split(", ")]
    if files.empty:
        return pd.DataFrame([], columns=columns)
    state = json.loads(reached["incoming"].iloc[0]) if len(reached) else None
    table_name, feed = files["table_name"].iloc[0], files["feed"].iloc[0]
    rows = []
    for file_no, own in _layouts(files):
        if state is not None:
            for k in sorted(state.keys() | own.keys()):
                where = (table_name, feed, file_no)
                if k not in own:
                    rows.append((*where, "removed", k, state[k], ""))
                elif k not in state:
                    rows.append((*where, "added", k, "", own[k]))
                elif own[k] and state[k] and own[k] != state[k]:
                    rows.append((*where, "retyped", k, state[k], own[k]))
        state = step(state, own)
    return pd.DataFrame(rows, columns=columns)


def steps(heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """Raw differences (added, removed, retyped) of each file against the latest earlier one of its feed."""
    files = (
        heads.where("bucket is null")
        .groupBy("table_name", "feed", "file_no")
        .agg(F.collect_list(F.struct("field", "kind")).alias("fields"))
        .withColumn("block", F.floor(F.col("file_no") / block).cast("long"))
    )
    keys = ["table_name", "feed", "block"]
    summaries = files.groupBy(*keys).applyInPandas(_summarise, "table_name string, feed string, block long, layout string")
    reached = summaries.groupBy("table_name", "feed").applyInPandas(_reach, "table_name string, feed string, block long, incoming string")
    return files.groupBy(*keys).cogroup(reached.groupBy(*keys)).applyInPandas(_replay, STEPS)


def _plain(name: str):
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")


def pair_renames(changes: DataFrame, heads: DataFrame) -> DataFrame:
    """Among keys removed and added in one step, the pairs of one kind of content: old, new, score.

    Contents are compared as the cosine of the keys' profiles, those of the types they had at the step or those of
    all types, whichever are closer. Candidates are the removed times the added keys of one step, as many as the
    layout has keys. Each key takes its best partner that also takes it best; ties go to the first names.
    """
    where = ["table_name", "feed", "file_no"]
    gone = changes.where("change_kind = 'removed'").select(*where, F.col("field_name").alias("old"), "old_type")
    come = changes.where("change_kind = 'added'").select(*where, F.col("field_name").alias("new"), "new_type")
    both = gone.join(come, where)
    typed = heads.where("bucket >= 0").select("table_name", "field", F.substring("kind", 9, 20).alias("kind"), "bucket", "n")
    profile = typed.unionByName(typed.groupBy("table_name", "field", "bucket").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("")))
    norm = profile.groupBy("table_name", "field", "kind").agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    asked = both.select("table_name", "old", "new", F.explode(F.array(F.struct("old_type", "new_type"), F.struct(F.lit("").alias("old_type"), F.lit("").alias("new_type")))).alias("t"))
    pairs = asked.select("table_name", "old", "new", "t.*").distinct()
    at_old, at_new = ["table_name", "old", "old_type"], ["table_name", "new", "new_type"]
    dots = (
        pairs.join(profile.withColumnsRenamed({"field": "old", "kind": "old_type", "n": "x"}), at_old)
        .join(profile.withColumnsRenamed({"field": "new", "kind": "new_type", "n": "y"}), [*at_new, "bucket"])
        .groupBy("table_name", "old", "new", "old_type", "new_type")
        .agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))
    )
    cosines = (
        dots.join(norm.withColumnsRenamed({"field": "old", "kind": "old_type", "norm": "n_old"}), at_old)
        .join(norm.withColumnsRenamed({"field": "new", "kind": "new_type", "norm": "n_new"}), at_new)
        .select("table_name", "old", "new", F.struct("old_type", "new_type").alias("t"), F.try_divide("dot", F.col("n_old") * F.col("n_new")).alias("cosine"))
    )
    scored = (
        both.select("table_name", "old", "new", "old_type", "new_type")
        .distinct()
        .join(cosines, ["table_name", "old", "new"], "left")
        .where("t is null or t = struct(old_type, new_type) or t = struct('' as old_type, '' as new_type)")
        .groupBy("table_name", "old", "new", "old_type", "new_type")
        .agg(F.max(F.coalesce("cosine", F.lit(0.0))).alias("cosine"))
        .withColumn("score", F.col("cosine") + F.when(_plain("old") == _plain("new"), 1.0).otherwise(0.0))
        .where(F.col("score") >= SAME_KIND)
        .select("table_name", "old", "new", "old_type", "new_type", "score")
    )
    best = (
        both.join(scored, ["table_name", "old", "new", "old_type", "new_type"])
        .withColumn("r_old", F.row_number().over(Window.partitionBy(*where, "old").orderBy(F.desc("score"), "new")))
        .withColumn("r_new", F.row_number().over(Window.partitionBy(*where, "new").orderBy(F.desc("score"), "old")))
        .where("r_old = 1 and r_new = 1")
    )
    return best.select(*where, "old", "new", "score")


CHANGES = ["table_name", "feed", "file_no", "change_kind", "field_name", "new_name", "old_type", "new_type"]


def drift(heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """The ordered log of layout changes: table_name, feed, file_no, change_kind, field_name, new_name, old_type,
    new_type. Where a rename also changes the type, it is one `renamed` row with both types.

    Defined cases: files without a readable keyed record (null, empty, cut off, positional) neither differ nor
    serve as an earlier file; the first readable file of a feed has no changes; a file sent again counts once;
    null values tell no type; a record without a file number belongs to no file.
    """
    changes = cut(steps(heads, block))
    where = ["table_name", "feed", "file_no"]
    renamed = pair_renames(changes, heads)
    rest = changes.join(renamed.select(*where, F.col("old").alias("field_name"), F.lit("removed").alias("change_kind")), [*where, "field_name", "change_kind"], "left_anti").join(
        renamed.select(*where, F.col("new").alias("field_name"), F.lit("added").alias("change_kind")), [*where, "field_name", "change_kind"], "left_anti"
    )
    old = changes.where("change_kind = 'removed'").select(*where, F.col("field_name").alias("old"), "old_type")
    new = changes.where("change_kind = 'added'").select(*where, F.col("field_name").alias("new"), "new_type")
    moved = renamed.join(old, [*where, "old"]).join(new, [*where, "new"])
    return rest.withColumn("new_name", F.lit("")).select(*CHANGES).unionByName(
        moved.select(*where, F.lit("renamed").alias("change_kind"), F.col("old").alias("field_name"), F.col("new").alias("new_name"), "old_type", "new_type")
    )


Lineages = dict[str, dict[str, tuple[str, str]]]


def lineages(changes: DataFrame, heads: DataFrame) -> Lineages:
    """table_name -> key -> (canonical name, promoted type): keys renamed in any feed of a table form one lineage, named
    by its first key in order. Top-level keys that no record holds have none.

    The driver holds the distinct (table, key, type) and the distinct renames: as many rows as there are key names, not
    records. Fails above 100,000 names, which no table could have as columns.
    """
    limit = 100_000
    fields = heads.where("bucket is null or bucket < 0").groupBy("table_name", "field", "kind").agg(F.min("file_no").alias("first")).take(limit + 1)
    pairs = changes.where("change_kind = 'renamed'").select("table_name", "field_name", "new_name").distinct().take(limit + 1)
    if max(len(fields), len(pairs)) > limit:
        raise ValueError("more than 100,000 key names: these are data, not a schema")
    tops = {(r["table_name"], r["field"]) for r in fields if r["kind"] == "top"}
    held = {(r["table_name"], r["field"]) for r in fields if r["kind"] not in ("top", "array")}
    fields = [r for r in fields if (r["table_name"], r["field"]) not in tops - held and r["kind"] != "top"]
    root = {(r["table_name"], r["field"]): (r["table_name"], r["field"]) for r in fields}
    first: dict[tuple[str, str], int] = {}
    for r in fields:
        key = (r["table_name"], r["field"])
        first[key] = min(first.get(key, r["first"]), r["first"])

    def find(x: tuple[str, str]) -> tuple[str, str]:
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        ends = [(r["table_name"], r["field_name"]), (r["table_name"], r["new_name"])]
        if not all(e in root for e in ends):  # top-level keys
            continue
        a, b = map(find, ends)
        if a != b:
            keep, drop = sorted((a, b), key=lambda k: (first[k], k))
            root[drop] = keep
    kinds: dict[tuple[str, str], str | None] = {}
    for r in sorted(fields, key=lambda r: (r["field"], r["kind"])):
        at = find((r["table_name"], r["field"]))
        kinds[at] = promote(kinds.get(at), None if r["kind"] == "null" else r["kind"])
    out: Lineages = {}
    for table_name, key in root:
        at = find((table_name, key))
        out.setdefault(table_name, {})[key] = (at[1], kinds[at] or "string")
    return out


def _cell(value: object, kind: str) -> str | None:
    if value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


_SQL_TYPES = {"number": "double", "boolean": "boolean"}


def unify(raw: DataFrame, names: Lineages, wrapped: bool) -> DataFrame:
    """All keyed records as one table: table_name, feed, file_no, record_no, one column per lineage, cast to its promoted
    type over all tables (numbers double, booleans boolean, everything else string; objects and arrays as JSON), and `also`.

    Keys of one lineage that occur in one record: the first non-null in the record's order stands in the column, the
    others in `also` (JSON, by key; null where there are none), so no value is lost. A clash of a lineage's name with
    another column gets the prefix `f_`.
    """
    reserved = {"table_name", "feed", "file_no", "record_no", "also"}
    kinds: dict[str, str] = {}
    for of in names.values():
        for n, t in of.values():
            kinds[n] = promote(kinds.get(n), t) or t
    targets = sorted(kinds)
    columns = [f"f_{n}" if n.lower() in reserved else n for n in targets]
    at = {n: i for i, n in enumerate(targets)}
    place = {t: {k: at[n] for k, (n, _) in of.items()} for t, of in names.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [batch.column(c).to_pylist() for c in ("table_name", "feed", "file_no", "body")]
            rows: list[list] = []
            for table_name, feed, file_no, body in zip(*head, strict=True):
                _, records = _records(parse(body), wrapped)
                for i, record in enumerate(records):
                    out: list = [table_name, feed, file_no, i] + [None] * (len(targets) + 1)
                    also: dict[str, object] = {}
                    for key, value in record.items():
                        to = place.get(table_name, {}).get(key)
                        if value is None:
                            continue
                        if to is not None and out[4 + to] is None:
                            out[4 + to] = _cell(value, kinds[targets[to]])
                        else:
                            also[key] = value
                    out[-1] = json.dumps(also, ensure_ascii=False) if also else None
                    rows.append(out)
            if rows:
                types = [pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * (len(targets) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["table_name", "feed", "file_no", "record_no", *(f"c{i}" for i in range(len(targets))), "also"])

    schema = "table_name string, feed string, file_no long, record_no long" + "".join(f", c{i} string" for i in range(len(targets))) + ", also string"
    out = raw.select("table_name", "feed", F.col("file_no").cast("long").alias("file_no"), F.col("body").cast("string").alias("body")).mapInArrow(scan, schema)
    cast = [F.col(f"c{i}").try_cast(_SQL_TYPES.get(kinds[n], "string")).alias(c) for i, (n, c) in enumerate(zip(targets, columns, strict=True))]
    return out.select("table_name", "feed", "file_no", "record_no", *cast, "also")
