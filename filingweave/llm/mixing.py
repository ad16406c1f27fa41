"""Mixing sources to target weights (problem 7).

Documents are counted in tokens of a public tokenizer. Each source's documents are dealt to shards and put into a
seeded order; a shard's part of a source is a row of blocks of equal tokens, the last of them shorter. Sainte-Laguë
apportionment gives every block of the mixture to the source with the highest quotient share / (2 a + 1), a being the
blocks it has, as long as its cap (its tokens times max_repeats) allows; then each source's blocks go to its shards by the
same rule. A shard with a quota of q tokens out of n uses all its documents q // n times and those of the first q % n
tokens in the seeded order once more, so a source misses its due by less than half a document a shard.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingweave.llm.corpus import plain_source
from filingweave.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the byte-level vocabulary (a fixed value of the tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 512
SHARD_TOKENS = 1_000_000_000
SEED = 17
MOST_CELLS = 100_000  # pairs of a source and a shard, of which each is a row on the driver; shards grow beyond


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with Path(path).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source (spelling apart), tokens of every document; null texts have none. Whole texts are encoded."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_source().alias("source"), "text")
    return rows.mapInArrow(scan, "doc_id long, source string, tokens long")


def apportion(seats: int, weights: dict[str, float], caps: dict[str, int]) -> dict[str, int]:
    """Sainte-Laguë with caps: `seats` by the highest quotients weight / (2 a + 1), ties to the first name.

    Exact for any number of seats: a bisection on the divisor gives all seats that are certain, the rest are dealt
    one by one. Where all caps are full, fewer seats are given.
    """
    names = sorted(n for n in weights if weights[n] > 0 and caps.get(n, 0) > 0)
    seats = min(seats, sum(caps[n] for n in names))
    given = dict.fromkeys(weights, 0)
    if not names or seats <= 0:
        return given

    def at(scale: float) -> dict[str, int]:
        return {n: min(caps[n], int(weights[n] * scale + 0.5)) for n in names}

    low, high = 0.0, 1.0
    while sum(at(high).values()) < seats:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle).values()) <= seats else (low, middle)
    given.update({n: max(0, a - 1) for n, a in at(low).items()})  # one less each: rounding can't give too many
    heap = [(-weights[n] / (2 * given[n] + 1), n) for n in names if given[n] < caps[n]]
    heapq.heapify(heap)
    for _ in range(seats - sum(given.values())):
        _, n = heapq.heappop(heap)
        given[n] += 1
        if given[n] < caps[n]:
            heapq.heappush(heap, (-weights[n] / (2 * given[n] + 1), n))
    return given


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source (spelling apart) -> (target share, max repeats). The targets are a configuration and read by the driver.

    Sources named twice add their shares and take the lower cap; null shares are 0, null caps 1.
    """
    rows = targets.select(plain_source().alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("most"))
    got = rows.groupBy("source").agg(F.sum("share").alias("share"), F.min("most").alias("most")).collect()
    return {r["source"]: (max(0.0, r["share"]), max(0, r["most"])) for r in got}


def mix(documents: DataFrame, targets: DataFrame, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): doc_id, source, tokens, copies of every document (0 where it isn't used); and per source
    target_share, due_share (the target's part of those that have documents), max_repeats, n_docs, tokens_available,
    blocks, quota_blocks, tokens_used, most_copies, actual_share.

    Without a budget the mixture is the largest in which every source that has documents can reach its share under
    its cap. Sources without a target get no blocks; targets without documents are reported with nothing used.
    Empty tables give empty results; a document stored twice counts twice.
    """
    spark: SparkSession = documents.sparkSession
    wanted = targets_of(targets)
    counted = cut(count_tokens(documents, path))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, min(-(-int(total) // shard_tokens), MOST_CELLS // max(1, len(wanted))))
    dealt = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int"))
    named = spark.createDataFrame([(s,) for s in wanted], "source string")
    cells: dict[str, dict[str, int]] = {s: {} for s in wanted}
    for r in dealt.join(named, "source", "left_semi").groupBy("source", "shard").agg(F.sum("tokens").alias("t")).where("t > 0").toLocalIterator():
        cells[r["source"]][f"{r['shard']:09d}"] = r["t"]
    blocks_in = lambda tokens: -(-tokens // block_tokens)
    have = {s: sum(of.values()) for s, of in cells.items()}
    caps = {s: blocks_in(have[s] * most) for s, (_, most) in wanted.items()}
    present = sum(share for s, (share, _) in wanted.items() if caps[s])
    if budget_tokens is None:
        reach = [have[s] * most / share for s, (share, most) in wanted.items() if share > 0 and caps[s]]
        seats = int(min(reach) * present / block_tokens) if reach else 0
    else:
        seats = budget_tokens // block_tokens
    quota = apportion(seats, {s: share for s, (share, _) in wanted.items()}, caps)
    rows = []
    for s, (_, most) in wanted.items():
        parts = apportion(quota[s], {k: float(t) for k, t in cells[s].items()}, {k: blocks_in(t * most) for k, t in cells[s].items()})
        for k, t in cells[s].items():
            due = min(parts[k] * block_tokens, t * most)
            rows.append((s, int(k), due // t, due % t))
    plan = spark.createDataFrame(rows, "source string, shard int, base long, more long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    placed = dealt.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")).join(plan, ["source", "shard"], "left")
    once_more = F.when(F.col("before") + F.col("tokens") / 2 < F.col("more"), 1).otherwise(0)
    copies = F.coalesce(F.col("base") + once_more, F.lit(0))
    selection = placed.select("doc_id", "source", "tokens", F.when(F.col("tokens") > 0, copies).otherwise(0).cast("long").alias("copies"))
    used = selection.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens_available"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    goal = spark.createDataFrame(
        [(s, share, share / present if caps[s] and present else 0.0, most, blocks_in(have[s]), quota[s]) for s, (share, most) in wanted.items()],
        "source string, target_share double, due_share double, max_repeats int, blocks long, quota_blocks long",
    )
    everything = Window.partitionBy(F.lit(1))
    shares = (
        goal.join(used, "source", "left")
        .na.fill(0, ["n_docs", "tokens_available", "tokens_used", "most_copies"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_used").cast("double"), F.sum("tokens_used").over(everything)), F.lit(0.0)))
    )
    return selection, shares
