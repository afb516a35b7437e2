"""Mixing sources to target weights by balanced sampling with the cube method.

A source's documents are taken `target / source size` times each: the whole part for all of them, the fraction by a sample. The sample moves every
document's inclusion probability along vectors of the constraints' null space, which leaves the source's token total and document total where they
are, until each probability is 0 or 1. Documents fly in blocks of bounded size; of each block at most two are undecided, these meet again
in the next round's blocks, and so on until one block a source is left. Its last two documents are landed where the token total comes nearest, and
what they leave over is made good by documents of that block that change places.

Edge cases: a null text has size 0; a null source is a source, the last one; a source without words has target 0; repeated rows are
mixed one by one; ties are broken by id, so reruns agree; an empty table gives an empty result; other columns are ignored by `mix` and
passed through by `mixed`.
"""

from __future__ import annotations

import bisect
import random
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V

WORD = "[^\\x20\\x09-\\x0D]+"
MOST_TIMES = 3
BLOCK_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, most: float = MOST_TIMES) -> dict[str | None, float]:
    """Words each source gives to the mix. Weights default to 1, 2, 3, 1, ... by name, null last. What a source's limit cuts off goes to the others."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = weights or {s: 1 + i % 3 for i, s in enumerate(names)}
    targets: dict[str | None, float] = {}
    free, rest = list(names), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / total > most * sizes[s]]
        if not over:
            targets |= {s: rest * weights[s] / total for s in free}
            break
        targets |= {s: float(most * sizes[s]) for s in over}
        rest -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in targets]
    return targets


def fly(size: list[int], p: list[float], rng: random.Random) -> list[int]:
    """Moves p in place; Σp and Σ size·p stay. Returns the places that are still undecided: two at most."""
    held: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # The null space of the rows (1, 1, 1) and (size a, size b, size c); any direction that sums to 0 where all sizes are equal.
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1, -1, 0)
        up = min(((1 - p[k]) if d > 0 else p[k]) / abs(d) for k, d in zip(held, u, strict=True) if d)
        down = min((p[k] if d > 0 else (1 - p[k])) / abs(d) for k, d in zip(held, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(held, u, strict=True):
            p[k] += step * d
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        held = [k for k in held if 0 < p[k] < 1]
    return held


def land(size: list[int], p: list[float], held: list[int]) -> None:
    """The landing problem: decide the last places so that the token total changes least, then let pairs of the block's documents change
    places, which leaves the document total alone, as long as that brings the token total nearer."""
    want = sum(size[k] * p[k] for k in held)
    options = range(1 << len(held))
    best = min(options, key=lambda o: (abs(sum(size[k] for j, k in enumerate(held) if o >> j & 1) - want), o))
    for j, k in enumerate(held):
        p[k] = float(best >> j & 1)
    over = sum(size[k] * p[k] for k in held) - want
    for _ in range(8):
        taken = [k for k in range(len(p)) if p[k] == 1]
        free = sorted((size[k], k) for k in range(len(p)) if p[k] == 0)
        found = None
        for k in taken:
            at = bisect.bisect_left(free, (size[k] - over, -1))
            for other, j in free[max(0, at - 1) : at + 1]:
                miss = abs(over - (size[k] - other))
                if miss < abs(over) - 0.5 and (found is None or (miss, k) < found[:2]):
                    found = (miss, k, j)
        if found is None:
            return
        _, k, j = found
        p[k], p[j] = 0.0, 1.0
        over -= size[k] - size[j]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, most: float = MOST_TIMES, block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    """id, text_crc32, size, source, source_size, target, times and taken of every row. One row a source comes to the driver."""
    spark = docs.sparkSession
    V.tune(spark)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(text).alias("_size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"))
    # The texts are read once. Equal rows are put together before they meet, and parted again by number.
    rows = V.written(rows.groupBy("_id", "_source", "_size", "_crc").agg(F.count("*").alias("_equal")), "sizes")
    found = rows.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_equal")).alias("size"), F.sum("_equal").alias("n")).collect()
    sizes = {r["_source"]: r["size"] for r in found}
    targets = source_targets(sizes, weights, most)
    blocks = {r["_source"]: -(-r["n"] // block_rows) for r in found}
    table = []
    for s, size in sizes.items():
        times = min(float(most), targets[s] / size) if size else 0.0
        whole = int(times + 1e-12)
        table.append((s, size, targets[s], whole, max(0.0, times - whole) if times - whole > 1e-12 else 0.0, blocks[s]))
    kinds = "_s string, source_size long, target double, _whole int, _p double, _blocks int"
    sources = spark.createDataFrame(table, kinds)
    # one row a source; Spark's own size limit decides on broadcasting
    rows = rows.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    # A row that is there very often is parted in two steps, block_rows at a time in each, so that no task deals out all of them.
    numbers = lambda low, high: F.explode(F.sequence(low, high))
    rows = rows.withColumn("_part", numbers(F.lit(0), F.floor((F.col("_equal") - 1) / block_rows).cast("int")))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_crc", "_part"), F.col("_blocks")).cast("int")).repartition("_source", "_block")
    most_here = F.least(F.lit(block_rows).cast("long"), F.col("_equal") - F.col("_part") * block_rows)
    rows = rows.withColumn("_n", numbers(F.lit(1), most_here.cast("int")))
    rows = rows.withColumn("_block", F.when(F.col("_equal") > 1, F.pmod(F.xxhash64("_id", "_crc", "_part", "_n"), F.col("_blocks")).cast("int")).otherwise(F.col("_block"))).drop("_equal", "_part", "_n")
    schema = rows.schema

    def flight(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        last = part.column("_blocks")[0].as_py() == 1
        part = part.sort_by([("_size", "descending"), ("_id", "ascending"), ("_crc", "ascending")])
        size, p = part.column("_size").to_pylist(), part.column("_p").to_pylist()
        name = part.column("_source")[0].as_py()
        rng = random.Random(zlib.crc32(f"{seed} {name!r} {part.column('_block')[0].as_py()} {len(p)}".encode()))
        held = fly(size, p, rng)
        if last and held:
            land(size, p, held)
        return part.set_column(part.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    decided = []
    most_blocks = max(blocks.values(), default=1)
    while True:
        rows = rows.groupBy("_source", "_block").applyInArrow(flight, schema)
        if most_blocks <= 1:
            decided.append(rows)
            break
        rows = V.written(rows, "mix")
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        decided.append(rows.where(~open_))
        fewer = F.ceil(F.col("_blocks") * 2 / F.lit(block_rows)).cast("int")
        rows = rows.where(open_).withColumn("_block", F.pmod("_block", fewer).cast("int")).withColumn("_blocks", fewer).select(schema.names)
        most_blocks = -(-most_blocks * 2 // block_rows)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    times = (F.col("_whole") + F.round("_p")).cast("long")
    return out.select(
        F.col("_id").alias(id_col), F.col("_crc").alias("text_crc32"), F.col("_size").alias("size"), F.col("_source").alias("mix_source"), "source_size", "target", times.alias("times"), (times * F.col("_size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, with all its columns."""
    key = lambda i, c, s: F.struct(i.alias("i"), c.alias("c"), s.alias("s")).alias("_key")
    took = mix(docs, id_col, text_col, source_col, **options)
    # Rows of one id, text and source can't be told apart: each is taken as often as all of them evenly are, and one of them makes up the rest.
    took = took.groupBy(key(F.col(id_col), F.col("text_crc32"), F.col("mix_source"))).agg(F.sum("times").alias("_all"), F.count("*").alias("_many")).where("_all > 0")
    took = V.written(took, "taken")
    # The row travels as one value, so that no column of it can clash.
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.struct("*").alias("_row"), key(F.col(id_col), F.crc32(text.cast("binary")), F.col(source_col).cast("string")))
    joined = left.join(took, "_key")
    again = lambda times: F.explode(F.sequence(F.lit(1), times.cast("int")))
    each = F.floor(F.col("_all") / F.col("_many"))
    out = joined.where(each > 0).select("_row", again(each).alias("_again"))
    rest = joined.where(F.col("_all") % F.col("_many") > 0).groupBy("_key").agg(F.first("_row").alias("_row"), F.max(F.col("_all") % F.col("_many")).alias("_more"))
    out = out.unionByName(rest.select("_row", again(F.col("_more")).alias("_again")))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
