"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots and stays there for good. Bytes are summed by slot, and a versioned map
says which shard holds a slot. Rebalancing and growing edit that map and leave the hashing alone, so only the records of the moved slots move.
The map and the sums have one row a slot: their size is `n_slots`, whatever the table's size.

The law is that of bytes. Equal texts share a slot and so a shard, unless their group is too large for one: a group with over a quarter of a shard's bytes, or with over four
slots' share of the rows and over `DEALT_ROWS` of them, is dealt out over the slots by id. The map names these groups; one that has been dealt out stays so in every later version. There are at
most 4 x shards of the first kind and a quarter of the slots of the second. A single text is never split, so shards are even up to the size of the longest one.

Edge cases: a null text has no bytes and still counts as one (its end mark), and is of one group with the empty text; a text of any length is measured whole; a null id hashes like any other value; rows equal in id and text
share a slot in every case and are numbered apart; an empty table gives an empty result; very large slots are split by raising `n_slots`; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.session import written

N_SLOTS = 8192
#: Groups of equal texts with no more rows than this are dealt out for their bytes only.
DEALT_ROWS = 1000


@dataclass
class SlotMap:
    """Which shard holds each virtual slot, and the edits that led there; every edit is a new version. `dealt` has the hashes of the texts whose copies are dealt out by id."""

    shards: list[int]
    version: int = 1
    edits: list[list[int]] = field(default_factory=list)
    dealt: list[int] = field(default_factory=list)

    @classmethod
    def even(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([slot * n_shards // n_slots for slot in range(n_slots)])

    def edited(self, moves: dict[int, int]) -> SlotMap:
        """The next version: `moves` has the new shard of each moved slot."""
        out = [moves.get(slot, shard) for slot, shard in enumerate(self.shards)]
        return SlotMap(out, self.version + 1, [[slot, self.shards[slot], to] for slot, to in sorted(moves.items())], self.dealt)

    def rebalanced(self, sizes: list[int], n_shards: int | None = None) -> SlotMap:
        """Move slots from the fullest shards to the emptiest ones until no single move lowers the fullest of the two any more."""
        n = n_shards or max(self.shards) + 1
        now = list(self.shards)
        held = [[] for _ in range(n)]
        load = [0] * n
        for slot, shard in enumerate(now):
            load[shard] += sizes[slot]
            if sizes[slot]:
                held[shard].append((-sizes[slot], slot))
        target = sum(load) / n
        spare = []
        for shard in range(n):
            held[shard].sort()
            keep = []
            # The largest slots stay as long as they fit under the mean; the rest is dealt out again.
            total = 0
            for size, slot in held[shard]:
                if total - size <= target:
                    total -= size
                    keep.append((size, slot))
                else:
                    spare.append((size, slot))
            held[shard], load[shard] = keep, total
        heap = [(load[shard], shard) for shard in range(n)]
        heapq.heapify(heap)
        for size, slot in sorted(spare):
            total, shard = heapq.heappop(heap)
            now[slot] = shard
            held[shard].append((size, slot))
            heapq.heappush(heap, (total - size, shard))
        load = [0] * n
        for total, shard in heap:
            load[shard] = total
        for _ in range(4 * n):
            high, low = max(range(n), key=lambda s: (load[s], -s)), min(range(n), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            best = None
            small = sorted((-a, slot) for a, slot in held[low])
            small.insert(0, (0, -1))
            at = 0
            for size, slot in sorted((-a, slot) for a, slot in held[high]):
                # A swap that shifts about half of the gap evens the two out.
                while at + 1 < len(small) and size - small[at + 1][0] >= gap / 2:
                    at += 1
                for give in small[max(0, at - 1) : at + 2]:
                    shift = size - give[0]
                    if 0 < shift < gap and (best is None or abs(2 * shift - gap) < abs(2 * best[0] - gap)):
                        best = (shift, size, slot, give)
            if best is None:
                break
            shift, size, slot, give = best
            held[high].remove((-size, slot))
            held[low].append((-size, slot))
            now[slot] = low
            if give[1] >= 0:
                held[low].remove((-give[0], give[1]))
                held[high].append((-give[0], give[1]))
                now[give[1]] = high
            load[high] -= shift
            load[low] += shift
        return self.edited({slot: shard for slot, shard in enumerate(now) if shard != self.shards[slot]})

    def grown(self, sizes: list[int]) -> SlotMap:
        """One shard more: it takes slots from the others until it holds its share, and no slot moves between the others."""
        n = max(self.shards) + 2
        target, load, taken = sum(sizes) / n, 0, {}
        left = [0] * (n - 1)
        for slot, shard in enumerate(self.shards):
            left[shard] += sizes[slot]
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            shard = self.shards[slot]
            if sizes[slot] and load + sizes[slot] <= target and left[shard] - sizes[slot] >= target * (n - 2) / (n - 1):
                taken[slot] = n - 1
                load += sizes[slot]
                left[shard] -= sizes[slot]
        return self.edited(taken)

    def save(self, spark: SparkSession, folder: str) -> None:
        """One Parquet folder for each version; earlier versions stay."""
        row = [(self.version, json.dumps(self.shards), json.dumps(self.edits), json.dumps(self.dealt))]
        spark.createDataFrame(row, "version int, shards string, edits string, dealt string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The named version, or the latest."""
        table = spark.read.parquet(f"{folder}/version=*") if version is None else spark.read.parquet(f"{folder}/version={version}")
        row = table.select("version", "shards", "edits", "dealt").orderBy(F.desc("version")).first()
        return cls(json.loads(row["shards"]), row["version"], json.loads(row["edits"]), json.loads(row["dealt"]))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.shards)), "vslot int, shard int")


def slot_of(id_col: Column, group: Column, n_slots: int = N_SLOTS, dealt: Column | bool = False) -> Column:
    """The record's virtual slot: that of its text's hash, or, where `dealt` holds, that of its id and text. The text is hashed there too, so that many rows of one id don't share a slot."""
    dealt = F.lit(dealt) if isinstance(dealt, bool) else dealt
    return F.pmod(F.when(dealt, F.xxhash64(id_col, group)).otherwise(group), F.lit(n_slots)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, size, text_crc32 and the text's hash of every record: narrow rows, read in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"))


def large_groups(rows: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Hashes of the texts whose copies are too many for one slot: at most 4 x n_shards + n_slots / 4."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    groups = rows.groupBy("_group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    heavy = (F.col("size") > total["size"] / (4 * n_shards)) | (F.col("n") > max(DEALT_ROWS, 4 * total["n"] / n_slots))
    return sorted(r["_group"] for r in groups.where((F.col("n") > 1) & heavy).collect())


def slotted(rows: DataFrame, dealt: list[int], id_col: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, text_crc32 and virtual slot of the records of `measured`."""
    slot = slot_of(F.col("_id"), F.col("_group"), n_slots, F.col("_group").isin(dealt) if dealt else False)
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", slot.alias("vslot"))


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of each slot: one row a slot comes to the driver."""
    sizes, counts = [0] * n_slots, [0] * n_slots
    for row in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        sizes[row["vslot"]], counts[row["vslot"]] = row["size"], row["n"]
    return sizes, counts


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, at: SlotMap | None = None, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record's shard and its place there, and the map. Starts from the map `at` or an even one and evens the shards out by bytes.
    With `store`, both versions are stored in that folder, and records are placed by the latest one as read from there."""
    spark = docs.sparkSession
    narrow = written(measured(docs, id_col, text_col), "sizes")
    first = at or SlotMap.even(n_slots, n_shards)
    first = replace(first, dealt=sorted({*first.dealt, *large_groups(narrow, n_shards, n_slots)}))
    rows = slotted(narrow, first.dealt, id_col, n_slots)
    sizes, counts = slot_sizes(rows, n_slots)
    final = first.rebalanced(sizes, n_shards)
    if store:
        for version in (first, final):
            version.save(spark, store)
        final = SlotMap.load(spark, store)
    before, base = [0] * n_shards, []
    for slot, to in enumerate(final.shards):
        base.append((slot, to, before[to]))
        before[to] += counts[slot]
    # n_slots rows, whatever the table's size
    places = F.broadcast(spark.createDataFrame(base, "vslot int, shard int, before long"))
    order = Window.partitionBy("vslot").orderBy(F.col(id_col), F.col("text_crc32"), F.col("size"))
    out = rows.withColumn("_n", F.row_number().over(order)).join(places, "vslot")
    return out.withColumn("slot", F.col("before") + F.col("_n") - 1).drop("_n", "before"), final
