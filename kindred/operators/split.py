"""Entity-level splits and labelled pairs. Random steps are hash ranks: seeded, the same in every run, and the same in any engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.ranking import hash_bucket, ranked, seeded, uniform
from kindred.session import discard, written

SEED = 42
PAIRS_PER_ENTITY = 10
SPLITS = ("train", "val", "test")


def entity_split(entities: DataFrame, key: str = "vin", seed: int = SEED, rest: float = 0.30, test: float = 0.50) -> DataFrame:
    """(key, split): the entities in hash order, the last ceil(rest * n) of them split again into val and, of ceil(test * rest), test."""
    # Written once: the count, the buckets and the ranks all read it.
    keyed = written(entities.select(key).distinct(), "entities").withColumn("_h", seeded(seed, F.col(key)))
    n = keyed.count()
    n_rest = math.ceil(round(rest * n, 6))
    n_test = math.ceil(round(test * n_rest, 6))
    placed = ranked(keyed, ["_h", key], hash_bucket(F.col("_h")))
    split = F.when(F.col("rank") <= n - n_rest, "train").when(F.col("rank") <= n - n_test, "val").otherwise("test")
    return placed.select(key, split.alias("split"))


def positive_pairs(members: DataFrame, most: int = PAIRS_PER_ENTITY) -> DataFrame:
    """(vin, id1, id2): an entity's first `most` pairs in the order of their positions. They are made from its first rows, which come together once: a row at a position over `most` + 1 can't be in one."""
    first = members.where(F.col("pos") <= most + 1).groupBy("vin").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_rows")).where(F.size("_rows") > 1)
    after = lambda i: F.slice("_rows", i + 1, F.size("_rows"))
    each = F.transform(F.sequence(F.lit(1), F.size("_rows") - 1), lambda i: F.transform(after(i), lambda y: F.struct(F.element_at("_rows", i)["id"].alias("id1"), y["id"].alias("id2"))))
    return first.select("vin", F.inline(F.slice(F.flatten(each), 1, most)))


def numbered_rows(ids: DataFrame, id_to_key: DataFrame, id_col: str = "id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(row, id, vin): every row under a number from 1, in hash order, with its entity if it has one. Rows go to their buckets with the hash and the id alone; equal hashes are equal order columns."""
    keyed = ids.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in order)))).alias("_h"))
    bucket = F.conv(F.substring(F.hex("_h"), 1, 3), 16, 10).cast("int")
    return ranked(keyed, ["_h"], bucket, "row").select("row", "id").join(id_to_key, "id", "left").select("row", "id", "vin")


def _tried(numbered: DataFrame, cells: list[tuple[str, int, int, int]], n: int) -> DataFrame:
    """(split, attempt, id1, id2): the tries first to last of each cell (split, seed, first, last) whose rows are of different entities."""
    pick = lambda seed, side: uniform(seeded(seed, F.col("attempt"), F.lit(side)), F.lit(n)) + 1
    tries = None
    for name, seed, first, last in cells:
        one = numbered.sparkSession.range(first, last + 1).withColumnRenamed("id", "attempt").select(F.lit(name).alias("split"), "attempt", pick(seed, "a").alias("r1"), pick(seed, "b").alias("r2"))
        tries = one if tries is None else tries.unionByName(one)
    one, two = (numbered.select(F.col("row").alias(f"r{i}"), F.col("id").alias(f"id{i}"), F.col("vin").alias(f"v{i}")) for i in (1, 2))
    return tries.where("r1 <> r2").join(one, "r1").join(two, "r2").where(~F.col("v1").eqNullSafe(F.col("v2"))).select("split", "attempt", "id1", "id2")


def _last_attempt(good: DataFrame, split: str, counts: dict[int, int], wanted: int, bucket: Column) -> int:
    """The attempt of the `wanted`-th good one: found by the counts of the buckets of attempts, and in one bucket."""
    seen = 0
    for b in sorted(counts):
        if seen + counts[b] >= wanted:
            return good.where((F.col("split") == split) & (bucket == b)).select("attempt").orderBy("attempt").offset(wanted - seen - 1).first()[0]
        seen += counts[b]
    raise ValueError("fewer good attempts than wanted")


def negatives(numbered: DataFrame, wanted: dict[str, tuple[int, int]], attempts: int = 5, n: int | None = None) -> DataFrame:
    """(split, attempt, id1, id2) for each split of `wanted` (its number of pairs and seed): hash-picked pairs of numbered rows whose entities differ; the first good ones of `attempts` x wanted tries.

    Tries are made in rounds, the first a little larger than what is wanted, and further ones only while good ones lack, so that tries that can't be among the first never meet the rows. All splits share a round."""
    n = numbered.count() if n is None else n
    open_ = {s: (w, seed, 0, 0) for s, (w, seed) in wanted.items() if w}
    if not n or not open_:
        return numbered.sparkSession.createDataFrame([], "split string, attempt long, id1 string, id2 string")
    cuts, made = {}, []
    while open_:
        cells = []
        for s, (w, seed, done, got) in open_.items():
            share = got / done if done else 1.0
            more = math.ceil((w - got) * 1.1 / share) + 100 if share else w * attempts
            cells.append((s, seed, done + 1, min(done + more, w * attempts)))
        good = written(_tried(numbered, cells, n), "negatives")
        made.append(good)
        # As many buckets at every size.
        width = max(max(last for *_, last in cells) // 4096, 1)
        bucket = F.floor(F.col("attempt") / width)
        counts: dict[str, dict[int, int]] = {}
        for r in good.groupBy("split", bucket.alias("b")).agg(F.count("*").alias("k")).collect():
            counts.setdefault(r["split"], {})[r["b"]] = r["k"]
        for s, seed, _, last in cells:
            w, _, _, got = open_[s]
            now = sum(counts.get(s, {}).values())
            if got + now >= w:
                cuts[s] = _last_attempt(good, s, counts[s], w - got, bucket)
            if got + now >= w or last >= w * attempts:
                del open_[s]
            else:
                open_[s] = (w, seed, last, got + now)
    last = F.lit(None).cast("long")
    for s, cut in cuts.items():
        last = F.when(F.col("split") == s, cut).otherwise(last)
    out = made[0]
    for good in made[1:]:
        out = out.unionByName(good)
    return out.where(F.coalesce(F.col("attempt") <= last, F.lit(True)))


def negative_pairs(numbered: DataFrame, wanted: int, seed: int, attempts: int = 5, n: int | None = None) -> DataFrame:
    """(attempt, id1, id2): hash-picked pairs of numbered rows whose entities differ; the first `wanted` of `attempts` x wanted tries. Two rows without an entity never differ."""
    return negatives(numbered, {"": (wanted, seed)}, attempts, n).select("attempt", "id1", "id2")


def positive_counts(members: DataFrame, splits: DataFrame, most: int = PAIRS_PER_ENTITY) -> dict[str, int]:
    """How many pairs `positive_pairs` gives each split, by arithmetic on the sizes of the entities (n, in each one's first row); no pair is made."""
    mine = members.where("pos = 1").select("vin", F.least(F.lit(most), F.expr("n * (n - 1) DIV 2")).alias("_k"))
    return {r["split"]: r["n"] for r in mine.join(splits, "vin").groupBy("split").agg(F.sum("_k").alias("n")).collect()}


def labelled_negatives(ids: DataFrame, id_to_key: DataFrame, counts: dict[str, int], seed: int = SEED, order: tuple[str, ...] = ("ord",), which: tuple[str, ...] = SPLITS) -> DataFrame:
    """(split, id1, id2): as many negatives from all rows as `counts` says, for each split of `which`."""
    numbered = written(numbered_rows(ids, id_to_key, order=order), "numbered")
    negative = negatives(numbered, {s: (counts.get(s, 0), seed + i) for i, s in enumerate(SPLITS) if s in which}).select("split", "id1", "id2")
    discard(numbered)
    return negative


def labelled_pairs(members: DataFrame, splits: DataFrame, ids: DataFrame, id_to_key: DataFrame, seed: int = SEED, order: tuple[str, ...] = ("ord",), which: tuple[str, ...] = SPLITS) -> DataFrame:
    """(split, id1, id2, label): an entity's positives in its split, and as many negatives from all rows for each split; of the splits in `which`. Both are written once."""
    positive = positive_pairs(members).join(splits.where(F.col("split").isin(*which)), "vin").select("split", "id1", "id2")
    positive = written(positive, "positives")
    counts = {r["split"]: r["n"] for r in positive.groupBy("split").agg(F.count("*").alias("n")).collect()}
    negative = labelled_negatives(ids, id_to_key, counts, seed, order, which)
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))


def split_assignment(rows: DataFrame, pairs: DataFrame, id_col: str = "id", default: str = "exclude") -> DataFrame:
    """rows with the split of their id; of several, the last one in the order train, val, test. The join carries rows as they are given: leave out what isn't needed."""
    rank = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(3)
    named = lambda side: pairs.select(F.col(side).alias("_pid"), rank.alias("_r"))
    last = named("id1").unionByName(named("id2")).groupBy("_pid").agg(F.max("_r").alias("_last"))
    joined = rows.join(last, F.col(id_col) == F.col("_pid"), "left")
    name = F.when(F.col("_last") == 1, "train").when(F.col("_last") == 2, "val").when(F.col("_last") == 3, "test")
    return joined.withColumn("split", F.coalesce(name, F.lit(default))).drop("_pid", "_last")


def capped_sample(rows: DataFrame, by: str, most: dict, keys: list[str], seed: int = SEED) -> DataFrame:
    """At most most[value] rows for each value of `by`, picked by hash."""
    keyed = rows.withColumn("_h", seeded(seed, *map(F.col, keys)))
    placed = ranked(keyed, ["_h", *keys], hash_bucket(F.col("_h")), partition=(by,))
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col(by)]
    return placed.where(F.col("rank") <= limit).drop("_h", "rank")


def first_rows(rows: DataFrame, n: int, order: tuple[str, ...] = ("ord",), among: DataFrame | None = None) -> DataFrame:
    """The first n rows in input order.

    `among` may have the first order column of the rows, and of rows that were dropped since, where it is cheaper to read than they are. Its counts by ranges say up to which value the first rows may reach; only if there are n rows up to it, the rest is left
    unmade, else the value is raised, in the end to all rows."""
    if among is None:
        return rows.orderBy(*order).limit(n)
    column, ranges = order[0], 4096
    low, high = among.agg(F.min(column), F.max(column)).first()
    if low is None:
        return rows.orderBy(*order).limit(n)
    cell = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high) + 1), F.lit(ranges))
    cells = among.where(F.col(column).isNotNull()).groupBy(cell.alias("_b")).agg(F.count("*").alias("_k"), F.max(column).alias("_to")).collect()
    wanted, seen = 2 * n, 0
    for b in sorted(cells, key=lambda r: r["_to"])[:-1]:
        seen += b["_k"]
        if seen < wanted:
            continue
        near = written(rows.where(F.col(column).isNull() | (F.col(column) <= b["_to"])), "first")
        if near.count() >= n:
            return near.orderBy(*order).limit(n)
        discard(near)
        wanted *= 4
    return rows.orderBy(*order).limit(n)
