from pyspark.sql import functions as F

from kindred.operators import blocking, evaluate, identity, mediate, profile, scoring, serialize, split


def members(spark, sizes):
    rows = [(v, f"{v}{i:02d}", i) for v, n in sizes.items() for i in range(n)]
    return identity.truth_members(spark.createDataFrame(rows, "Vin string, listing_id string, ord long"))


def test_truth_members_keep_order_and_drop_singles(spark):
    m = members(spark, {"a": 3, "b": 1})
    assert [(r["id"], r["pos"], r["n"]) for r in m.orderBy("pos").collect()] == [("a00", 1, 3), ("a01", 2, 3), ("a02", 3, 3)]
    assert identity.truth_map(m).first()["ids"] == ["a00", "a01", "a02"]


def test_id_under_two_keys_belongs_to_the_later(spark):
    m = spark.createDataFrame([("a", "1", 1, 2), ("b", "1", 1, 2)], "vin string, id string, pos int, n long")
    assert identity.id_to_key(m).first()["vin"] == "b"


def test_positive_pairs_stop_at_ten(spark):
    got = {(r["id1"], r["id2"]) for r in split.positive_pairs(members(spark, {"a": 12})).collect()}
    assert got == {("a00", f"a{j:02d}") for j in range(1, 11)}
    small = {(r["id1"], r["id2"]) for r in split.positive_pairs(members(spark, {"a": 4})).collect()}
    assert len(small) == 6


def test_entity_split_is_disjoint_seeded_and_proportional(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(101)], "vin string")
    one, two = (sorted(map(tuple, split.entity_split(df).collect())) for _ in range(2))
    assert one == two
    counts = {s: sum(x == s for _, x in one) for s in split.SPLITS}
    assert counts == {"train": 70, "val": 15, "test": 16} and len({v for v, _ in one}) == 101


def test_negatives_differ_and_two_unknown_never_pair(spark):
    ids = spark.createDataFrame([(str(i), i) for i in range(40)], "id string, ord long")
    known = spark.createDataFrame([(str(i), f"v{i % 3}") for i in range(30)], "id string, vin string")
    numbered = split.numbered_rows(ids, known)
    rows = split.negative_pairs(numbered, 25, 7).collect()
    owner = {r["id"]: r["vin"] for r in known.collect()}
    assert len(rows) == 25 and all(owner.get(r["id1"]) != owner.get(r["id2"]) for r in rows)
    assert split.negative_pairs(split.numbered_rows(ids, known.where("false")), 5, 7).count() == 0


def test_split_assignment_last_wins(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "id string")
    pairs = spark.createDataFrame([("train", "1", "2"), ("test", "2", "9"), ("val", "1", "8")], "split string, id1 string, id2 string")
    got = {r["id"]: r["split"] for r in split.split_assignment(rows, pairs).collect()}
    assert got == {"1": "val", "2": "test", "3": "exclude", None: "exclude"}


def listings(spark, n, ids=None):
    rows = [(ids[i] if ids else str(i), " Honda\t" if i % 2 else "honda", 2018.0, i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, make string, year double, ord long")


def test_pair_counts_and_repeated_ids(spark):
    df = listings(spark, 4, ["a", "a", "b", "10"])
    m = blocking.block_members(df, blocking.B1)
    assert blocking.pairs_by_position(m, blocking.B1).count() == 6
    by_id = {(r["id1"], r["id2"]) for r in blocking.pairs_by_id(m, blocking.B1).collect()}
    assert by_id == {("10", "a"), ("10", "b"), ("a", "b")}


def test_block_gates(spark):
    for n, rule, supervised in ((199, True, True), (200, False, True), (300, False, True), (301, False, False)):
        df = listings(spark, n)
        assert (blocking.block_members(df, blocking.B1, less_than=scoring.BLOCK_LIMIT).count() > 0) == rule
        assert (blocking.block_members(df, blocking.B1, less_than=301).count() > 0) == supervised


def test_first_blocks_by_key_order(spark):
    df = spark.createDataFrame([(str(i), m, 2000.0, i) for i, m in enumerate("bbaaccd")], "id string, make string, year double, ord long")
    kept = blocking.first_blocks(blocking.block_members(df, blocking.B1), blocking.B1, 2)
    assert {r["k_make"] for r in kept.collect()} == {"a", "b"}


def test_truth_and_records(spark):
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("3", "4"), ("9", "1")], "id1 string, id2 string")
    key = spark.createDataFrame([("1", "v"), ("2", "v"), ("3", "w")], "id string, vin string")
    assert sorted((r["id1"], r["id2"], r["truth"]) for r in blocking.with_truth(pairs, key).collect()) == [("1", "2", 1), ("1", "3", 0), ("3", "4", 0), ("9", "1", 0)]
    assert blocking.with_records(pairs, key, ("vin",)).count() == 2


def test_deduplication_policies(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, ord long, v string")
    pick = lambda k: sorted(r["v"] for r in identity.deduplicated(df, "id", keep=k).collect())
    assert (pick("first"), pick("last"), pick("all")) == (["x", "z"], ["y", "z"], ["x", "y", "z"])


def test_sweep_and_best_threshold(spark):
    rows = [("e", 0.9, 1), ("e", 0.8, 0), ("e", 0.6, 1), ("z", 0.1, 1)]
    report = evaluate.sweep(spark.createDataFrame(rows, "experiment string, score double, truth int"), (0.5, 0.85), ("experiment",))
    got = {(r["experiment"], r["threshold"]): (r["precision"], r["recall"], r["f1"]) for r in report.collect()}
    assert got == {("e", 0.5): (0.6667, 1.0, 0.8), ("e", 0.85): (1.0, 0.5, 0.6667), ("z", 0.5): (0.0, 0.0, 0.0), ("z", 0.85): (0.0, 0.0, 0.0)}
    best = {r["experiment"]: (r["threshold"], r["f1"]) for r in evaluate.best_threshold(report).collect()}
    assert best == {"e": (0.5, 0.8), "z": (0.0, 0.0)}


def test_recall_falls_with_the_threshold(spark):
    df = spark.range(200).select(F.lit("x").alias("g"), (F.col("id") / 200).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("truth"))
    r = [x["recall"] for x in evaluate.sweep(df, scoring.SWEEP, ("g",)).orderBy("threshold").collect()]
    assert r == sorted(r, reverse=True)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (None, "x")], "a int, b string")
    for approximate in (False, True):
        rows = [tuple(r) for r in profile.profile(df, approximate=approximate).collect()]
        assert rows == [("b", 75.0, 25.0, 1, True), ("a", 25.0, 50.0, 2, False)]
    assert profile.columns_to_drop(profile.profile(df)) == ["b"]
    assert [tuple(r) for r in profile.profile(df.where("false")).collect()] == [("a", None, None, 0, False), ("b", None, None, 0, False)]


def test_mediation(spark):
    shapes = spark.createDataFrame([(x,) for x in ("2021-05-04T12:31:18-05:00", "2021-05-04T17:31:18Z", "2021-05-04T17:31:18", "2021-05-04T23:01:18+0530")], "d string")
    assert {r[0] for r in shapes.select(F.date_format(mediate.utc_time(F.col("d")), "yyyy-MM-dd HH:mm:ss")).collect()} == {"2021-05-04 17:31:18"}
    one = spark.createDataFrame([("2021-05-04T12:31:18-0500", True), ("bad", None), ("2021-05-04", False)], "d string, n boolean")
    rows = one.select(F.date_format(mediate.utc_time(F.col("d")), "yyyy-MM-dd HH:mm:ss"), mediate.new_or_used(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("2021-05-04 17:31:18", "new"), (None, None), ("2021-05-04 00:00:00", "used")]


def test_rule_score_of_equal_records(spark):
    df = spark.createDataFrame([("1", "Honda", "Civic", 2018.0, 1.0, 2.0), ("2", " honda", "civic ", 2018.0, 1.0, 2.0), ("3", "ford", "focus", None, None, None)], "id string, make string, model string, year double, price double, mileage double")
    pairs = spark.createDataFrame([("1", "2"), ("1", "3")], "id1 string, id2 string")
    scored = scoring.features(blocking.with_records(pairs, scoring.rule_records(df), scoring.COMPARED)).withColumn("score", scoring.weighted())
    assert {r["id2"]: r["score"] for r in scored.collect()} == {"2": 1.0, "3": 0.0}


def test_serialized_text(spark):
    df = spark.createDataFrame([("1", 1, " Honda ", 2018.0), ("1", 2, None, 2019.0)], "id string, ord long, make string, year double")
    got = serialize.serialized(df, ("make", "year")).collect()
    assert [tuple(r) for r in got] == [("1", "COL make VAL  COL year VAL 2019.0")]


def test_matcher_metrics_without_lines_is_no_row(spark):
    none = spark.createDataFrame([], "line long, label int"), spark.createDataFrame([], "line long, match int")
    assert serialize.matcher_metrics(*none, "x", "1m", "1m 1s").count() == 0


# ---- pairs of large blocks


def test_tiles_make_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TILE_ROWS", 7)
    rows = [(f"{(i * 37) % 90:02d}", "honda" if i % 9 else "ford", 2018.0, i) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, make string, year double, ord long")
    m = blocking.block_members(df, blocking.B1)
    blocks = {k: [r for r in rows if r[1] == k] for k in ("honda", "ford")}
    by_position = sorted((r["id1"], r["id2"]) for r in blocking.pairs_by_position(m, blocking.B1).collect())
    assert by_position == sorted((a[0], b[0]) for rs in blocks.values() for i, a in enumerate(rs) for b in rs[i + 1 :])
    by_id = sorted((r["id1"], r["id2"], r["ord_1"], r["ord_2"]) for r in blocking.pairs_by_id(blocking.block_members(df, blocking.B1, positions=False), blocking.B1, carry=("ord",)).collect())
    assert by_id == sorted((a[0], b[0], a[3], b[3]) for rs in blocks.values() for a in rs for b in rs if a[0] < b[0])
    values = {(r["x"], r["y"]) for r in blocking.value_pairs(m, "id", blocking.B1).collect()}
    assert values == {(a[0], b[0]) for rs in blocks.values() for a in rs for b in rs if a[0] < b[0]}


def test_tiles_of_a_large_block_are_even(spark):
    """One block of 100,000 rows: no tile has more than TILE_ROWS squared pairs, and tasks get like numbers of them."""
    n = 100_000
    m = spark.range(1, n + 1).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("k_make"), F.lit("b").alias("k_year"), F.col("id").alias("pos"), F.lit(n).alias("block_size"))
    names, size = ["k_make", "k_year"], blocking.TILE_ROWS
    slot = F.floor((F.col("pos") - 1) / size)
    sides = m.select(slot.alias("s")).groupBy("s").count().collect()
    rows = {r["s"]: r["count"] for r in sides}
    tiles = {b * (b + 1) // 2 + a: rows[a] * rows[b] if a < b else rows[a] * (rows[a] - 1) // 2 for b in rows for a in rows if a <= b}
    assert sum(tiles.values()) == n * (n - 1) // 2 and max(tiles.values()) <= size**2
    # How Spark deals the tiles: copies of the rows, by the join's key.
    copies = m.withColumn("_b", F.explode(F.sequence(slot.cast("int"), F.lit(len(rows) - 1)))).select(*names, (F.col("_b").cast("long") * (F.col("_b") + 1) / 2 + slot).cast("long").alias("_tile"))
    loads = {}
    for r in copies.distinct().repartition(32, *names, "_tile").select(F.spark_partition_id().alias("p"), "_tile").collect():
        loads[r["p"]] = loads.get(r["p"], 0) + tiles[r["_tile"]]
    assert max(loads.values()) < 2 * sorted(loads.values())[len(loads) // 2]


def test_pairs_of_one_block_of_many_rows(spark):
    n = 6_000
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("honda").alias("make"), F.lit(2018.0).alias("year"), F.col("id").alias("ord"))
    pairs = blocking.pairs_by_id(blocking.block_members(df, blocking.B1, positions=False), blocking.B1)
    assert pairs.agg(F.count("*"), F.sum(F.col("id1").cast("long") + F.col("id2").cast("long"))).first()[:] == (n * (n - 1) // 2, (n - 1) * n * (n - 1) // 2)


def test_gate_loss_is_what_the_pairs_say(spark):
    rows = [(f"{i % 40}", f"m{i % 3}" if i % 5 else "m0", 2000.0, None if i % 7 == 0 else f"v{i % 40 % 6}", "train" if i % 2 else "test", i) for i in range(200)]
    key = {}
    for r in rows:
        key.setdefault(r[0], r[3])
    rows = [(*r[:3], key[r[0]], *r[4:]) for r in rows]
    df = spark.createDataFrame(rows, "id string, make string, year double, vin string, split string, ord long")
    got = {r["split"]: r.asDict() for r in blocking.gate_loss(df, blocking.B1, 35).collect()}
    for split_ in ("train", "test"):
        blocks = {}
        for r in rows:
            if r[4] == split_:
                blocks.setdefault(r[1], []).append(r)
        pairs = {k: [(a, b) for a in v for b in v if a[0] < b[0]] for k, v in blocks.items()}
        over = [k for k, v in blocks.items() if len(v) >= 35]
        true = lambda ks: sum(a[3] is not None and a[3] == b[3] for k in ks for a, b in pairs[k])  # noqa: B023, E731
        want = {"split": split_, "blocks": len(blocks), "dropped_blocks": len(over), "pairs": sum(map(len, pairs.values())), "dropped_pairs": sum(len(pairs[k]) for k in over), "true_pairs": true(pairs), "dropped_true_pairs": true(over)}
        assert got[split_] == want and over


def test_positions_of_hot_keys(spark, monkeypatch):
    rows = [("hot", i % 97, f"{i:04d}") for i in range(1000)] + [("cold", i, f"c{i}") for i in range(5)] + [(None, 1, "x"), (None, 0, "y"), ("same", 3, "b"), ("same", 3, "a")]
    df = spark.createDataFrame(rows, "k string, ord long, id string").repartition(7)
    from kindred.operators import ranking

    want = set()
    for k in ("hot", "cold", None, "same"):
        mine = sorted((r[1], r[2]) for r in rows if r[0] == k)
        want |= {(k, *r): (i, len(mine)) for i, r in enumerate(mine, 1)}
    for most in (1, 50, 10_000):
        got = {(r["k"], r["ord"], r["id"]): (r["pos"], r["n"]) for r in ranking.placed(df, ["k"], ["ord", "id"], total="n", most=most).collect()}
        assert got == want, most


def test_an_entity_of_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit("v").alias("Vin"), F.col("id").cast("string").alias("listing_id"), F.col("id").alias("ord"))
    m = identity.truth_members(df)
    assert m.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_if(F.col("pos") != F.col("id").cast("int") + 1), F.min("n")).first()[:] == (1_000_000, 1, 1_000_000, 0, 1_000_000)
    assert len(split.positive_pairs(m).collect()) == 10


def test_membership_instead_of_true_pairs(spark):
    m = spark.createDataFrame([("v", "1"), ("v", "2"), ("w", "2"), ("w", "3"), ("x", "4"), ("x", "4")], "vin string, id string")
    known = blocking.entities_of(m)
    pairs = [("1", "2"), ("1", "3"), ("2", "3"), ("3", "2"), ("4", "4"), ("2", "2"), ("1", "9"), ("9", "9")]
    rows = spark.createDataFrame(pairs, "id1 string, id2 string")
    one, two = (known.select(F.col("id").alias(f"id{i}"), F.col("vins").alias(f"v{i}"), F.col("twice").alias(f"t{i}")) for i in (1, 2))
    label = blocking.same_entity(F.col("id1"), F.col("id2"), F.col("v1"), F.col("v2"), F.col("t1"))
    got = {(r["id1"], r["id2"]): r["y"] for r in rows.join(one, "id1", "left").join(two, "id2", "left").select("id1", "id2", label.alias("y")).collect()}
    assert got == dict(zip(pairs, (1, 0, 1, 1, 1, 0, 0, 0), strict=True))


def test_sampled_pairs(spark):
    n = 2_000
    members_ = spark.range(1, n + 1).select(F.lit("b").alias("k"), F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), F.col("id").alias("ord"), F.lit(n).alias("block_size"))
    total = blocking.pair_total(members_.select("k", "block_size").distinct())
    assert total == n * (n - 1) // 2
    got = [(int(r["id1"]), int(r["id2"])) for r in blocking.sampled_pairs(members_, ["k"], 20_000, total, 1, ("ord",), ("ord",)).collect()]
    assert 18_500 < len(got) < 21_000 and len(set(got)) == len(got) and all(a < b for a, b in got)
    # Every pair has the same chance: a quarter of the pairs is among the first half of the rows.
    assert abs(sum(b <= n / 2 for _, b in got) / len(got) - 0.25) < 0.02
    few = members_.where("pos <= 20").withColumn("block_size", F.lit(20))
    assert blocking.sampled_pairs(few, ["k"], 500, 190, 1, ("ord",), ()).count() == 190


def test_sketches_merge_by_batch(spark):
    df = spark.range(20_000).select((F.col("id") % 5_000).alias("a"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("b"), F.lit(None).cast("double").alias("c"))
    whole = {r["attr"]: (r["n"], r["filled"], r["n_uniq"]) for r in profile.estimated(profile.sketches(df)).collect()}
    parts = [profile.sketches(df.where(F.col("a") % 3 == k)) for k in range(3)]
    both = {r["attr"]: (r["n"], r["filled"], r["n_uniq"]) for r in profile.estimated(profile.merged(*parts)).collect()}
    assert all(both[c][:2] == whole[c][:2] and abs(both[c][2] - whole[c][2]) <= 0.03 * whole[c][2] for c in "abc")
    assert whole["c"] == (20_000, 0, 0) and abs(whole["a"][2] - 5_000) < 200 and whole["b"][:2] == (20_000, 5_000)
    exact = {r["attr"]: r["n_uniq"] for r in profile.profile(df).collect()}
    assert exact == {"a": 5_000, "b": 5_000, "c": 0}


def test_profile_makes_no_row_of_a_cell(spark):
    df = spark.range(100).select(*(F.col("id").alias(f"c{i}") for i in range(6)))
    for approximate in (False, True):
        plan = profile.profile(df, approximate=approximate)._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan


def test_a_timed_report_counts_pairs_in_its_pass(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") / 500).alias("score"), (F.col("id") % 2).cast("int").alias("truth"))
    plain = lambda rows: evaluate.sweep(rows, (0.5,), ("g",))
    got = evaluate.timed(df, plain, train_time_sec=1.5).collect()
    want = plain(df).collect()
    assert [r[: len(want[0])] for r in got] == [tuple(r) for r in want] and got[0]["train_time_sec"] == 1.5
    assert got[0]["inference_time_sec"] > 0 and abs(got[0]["pairs_per_sec"] * got[0]["inference_time_sec"] / 500 - 1) < 0.2
    assert evaluate.timed(df.where("false"), plain).count() == 0


def test_negatives_are_the_first_good_tries_and_few_tries_meet_rows(spark, monkeypatch):
    import hashlib

    n, wanted = 40, 30
    numbered = spark.createDataFrame([(i + 1, f"r{i}", None if i % 3 else f"v{i % 6}") for i in range(n)], "row long, id string, vin string")
    rows = {r["row"]: r for r in numbered.collect()}
    pick = lambda seed, k, side: int(hashlib.md5(f"{seed}|{k}|{side}".encode()).hexdigest()[:8], 16) % n + 1
    want = set()
    for name, seed in (("train", 42), ("val", 43)):
        tries = [(k, rows[pick(seed, k, "a")], rows[pick(seed, k, "b")]) for k in range(1, 5 * wanted + 1)]
        good = [(k, a["id"], b["id"]) for k, a, b in tries if a["row"] != b["row"] and a["vin"] != b["vin"]]
        want |= {(name, *x) for x in good[:wanted]}
    tried = []
    made = split._tried
    monkeypatch.setattr(split, "_tried", lambda numbered, cells, n: tried.extend(cells) or made(numbered, cells, n))
    got = [tuple(r) for r in split.negatives(numbered, {"train": (wanted, 42), "val": (wanted, 43), "test": (0, 44)}).collect()]
    assert set(got) == want and len(got) == len(want) == 2 * wanted
    tried.clear()
    free = spark.range(1, 3001).selectExpr("id AS row", "CAST(id AS string) AS id", "CAST(id AS string) AS vin")
    assert split.negatives(free, {"train": (2000, 42)}).count() == 2000
    # A tenth more than is wanted, and not five times as many.
    assert sum(last - first + 1 for *_, first, last in tried) <= 2300


def test_written_rows_have_only_what_is_needed(spark, sf_dir):
    from kindred.plans import queries

    assert set(queries.Steps(spark, sf_dir, ("price",)).kept.columns) == {"listing_id", "Vin", "price", "ord", "key", "row_key"}


def test_weighted_pairs_and_counts_are_those_of_the_pairs(spark, monkeypatch):
    import random
    from itertools import combinations

    monkeypatch.setattr(blocking, "TILE_ROWS", 3)
    rnd = random.Random(5)
    kind = {f"i{i}": (rnd.choice("ab"), rnd.choice([None, 1.0, 2.0])) for i in range(14)}
    rows = [(rnd.choice("xy"), i, *kind[i]) for i in rnd.choices(sorted(kind), k=40)]
    again = {i for i in kind if sum(r[1] == i for r in rows) > 1}
    df = spark.createDataFrame([(*r, r[1] in again) for r in rows] + [("x", None, "a", 1.0, False)], "g string, id string, c string, v double, again boolean")
    want = {}
    for a, b in combinations(rows, 2):
        if a[0] == b[0] and a[1] != b[1]:
            key = (a[0], frozenset([a[2:], b[2:]]))
            want[key] = want.get(key, 0) + 1
    got = [(r["g"], frozenset([(r["c_1"], r["v_1"]), (r["c_2"], r["v_2"])]), r["weight"]) for r in blocking.weighted_pairs(df, ["g"], ("c", "v")).collect()]
    assert {g[:2]: g[2] for g in got} == want and len(got) == len(want)

    owns = {i: rnd.choices("pqr", k=rnd.choice([1, 2, 3])) for i in sorted(kind)[:11]}
    entities = blocking.entities_of(spark.createDataFrame([(v, i) for i, vs in owns.items() for v in vs], "vin string, id string"))
    blocks = spark.createDataFrame([(r[1], r[0], 1.0) for r in rows], "id string, make string, year double")
    hit = lambda a, b: (len(owns.get(a, [])) > len(set(owns.get(a, [])))) if a == b else bool(set(owns.get(a, [])) & set(owns.get(b, [])))
    met = [(a[1], b[1]) for a, b in combinations(rows, 2) if a[0] == b[0]]
    r = blocking.pair_counts(blocks, entities, blocking.B1).first()
    assert (r["pairs"], r["true_pairs"]) == (len(met), sum(hit(a, b) for a, b in met))


def test_small_dictionaries_leave_pairs_where_they_are(spark):
    from kindred.functions import similarity as S

    pairs = spark.range(1000).selectExpr("CONCAT('a', id % 7) AS a", "CONCAT('b', id % 5) AS b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.by_dictionary(pairs, "a", "b", "s", S.jaro_winkler_all)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_truth_pairs_are_not_shuffled(spark, monkeypatch):
    """Entities of ordinary and large size, ids in several entities, ids there twice and rows without an id: each pair once, as from all pairs of rows; pairs meet each other only where ids have several entities."""
    monkeypatch.setattr(blocking, "TILE_ROWS", 4)
    own = {"v1": ["a", "b", "c"], "v2": ["b", "c", "d", "d"], "v3": [*"abcdefghij", "e"], "v4": ["x", None, "y"], "v5": [None, None, "z"], "v6": ["p", "q"]}
    rows = [(v, i, p, len(ids)) for v, ids in own.items() for p, i in enumerate(ids, 1)]
    members_ = spark.createDataFrame(rows, "vin string, id string, pos int, n long")
    known = lambda x, y: tuple(sorted(i for i in (x, y) if i is not None)) or (None,)
    want = {(known(x, y)[0], known(x, y)[-1]) for ids in own.values() for k, x in enumerate(ids) for y in ids[k + 1 :]}
    got = [(r["a"], r["b"]) for r in blocking.truth_pairs(members_).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(blocking, "TILE_ROWS", 1024)
    plain = blocking.truth_pairs(members_.where("vin = 'v6' OR vin = 'v2'"))
    assert {(r["a"], r["b"]) for r in plain.collect()} == {("b", "c"), ("b", "d"), ("c", "d"), ("d", "d"), ("p", "q")}
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString() and "Distinct" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_leave_the_rest_unmade(spark):
    """The first rows are the same with and without the cheaper order column, also where most rows up to its first guess were dropped; rows after them are not made."""
    every = spark.range(5000).select((F.col("id") * 7 % 5000).alias("ord"), F.col("id").cast("string").alias("id"))
    sparse = every.where("ord > 4000 OR ord % 10 = 0")
    for rows in (every, sparse):
        for n in (10, 200, 600, 6000):
            want = [r["ord"] for r in split.first_rows(rows, n).collect()]
            assert [r["ord"] for r in split.first_rows(rows, n, among=every.select("ord")).collect()] == want
    failing = every.withColumn("x", F.when(F.col("ord") > 3000, F.raise_error(F.lit("made"))).otherwise(F.col("ord")))
    assert [r["x"] for r in split.first_rows(failing, 20, among=every.select("ord")).collect()] == list(range(20))


def test_positives_are_counted_without_being_made(spark):
    rows = [(f"v{e}", f"{e}-{i}", i + 1, n) for e, n in enumerate([2, 3, 4, 5, 6, 30]) for i in range(n)]
    members = spark.createDataFrame(rows, "vin string, id string, pos int, n long")
    splits = spark.createDataFrame([(f"v{e}", "train" if e % 2 else "test") for e in range(6)], "vin string, split string")
    made = split.positive_pairs(members).join(splits, "vin").groupBy("split").count().collect()
    assert split.positive_counts(members, splits) == {r["split"]: r["count"] for r in made} == {"train": 23, "test": 17}


def test_packed_records_give_the_same_lines(spark):
    odd = ["a b", "", None, "\x1f", "\x1e", "\x1e1x\x1f0", "\x1e\x1f ", "Tab\tNew"]
    rows = [(str(i % 6), i, x, y, float(i) / 3 if i % 4 else None) for i, (x, y) in enumerate((x, y) for x in odd for y in odd)]
    records = spark.createDataFrame(rows, "id string, ord long, make string, model string, price double")
    fields = ("make", "price", "model")
    pairs = spark.createDataFrame([("0", "1", 1), ("2", "3", 0), ("4", "5", 1), ("5", "5", 0), ("1", "none", 1)], "id1 string, id2 string, label int")
    want = serialize.pair_lines(pairs, serialize.serialized(records, fields)).collect()
    got = serialize.pair_lines_of(pairs, records, fields).collect()
    assert len(got) == 4 and sorted(got) == sorted(want)
    every = records.select(serialize.record_text(records, fields).alias("a"), serialize.unpacked(serialize.packed(records, fields), fields).alias("b"))
    assert every.where("a <> b OR a IS NULL OR b IS NULL").isEmpty()


def test_levels_of_cells_are_those_of_the_pairs(spark, monkeypatch):
    """Missing values, no numbers, infinities, near numbers and repeated ids; the kinds of a group are dealt out in several cells."""
    import random

    monkeypatch.setattr(blocking, "CELL", 7)
    rnd = random.Random(9)
    price = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 10.0, 10.05, 10.1, 10.11, 10.15, 10.2, 1e300]
    kind = {f"i{i}": (rnd.choice(["honda", "hondas", "", None]), rnd.choice(["civic", "civics", "accord", ""]), rnd.choice(["2018", "2019"]), rnd.choice(price), rnd.choice([5.0, 5.1, 6.0, None])) for i in range(50)}
    rows = [(rnd.choice("xy"), i, *kind[i]) for i in rnd.choices(sorted(kind), k=90)]
    again = {i for i in kind if sum(r[1] == i for r in rows) > 1}
    schema = "g string, id string, r_make string, r_model string, r_year string, r_price double, r_mileage double, again boolean"
    df = spark.createDataFrame([(*r, r[1] in again) for r in rows] + [("x", None, *rows[0][2:], False), ("z", "j", *rows[0][2:], False)], schema)
    levels = (0.35, 0.6, 0.85)
    for itself in (False, True):
        pairs = scoring.features(blocking.weighted_pairs(df, ["g"], scoring.COMPARED, itself)).withColumn("score", scoring.weighted())
        highest = F.coalesce(*(F.when(F.col("score") >= t, t) for t in reversed(levels)), F.lit(0.0))
        want = {(r["g"], r["level"]): r["w"] for r in pairs.groupBy("g", highest.alias("level")).agg(F.sum("weight").alias("w")).collect()}
        got = blocking.weighted_levels(df, ["g"], scoring.COMPARED, scoring.cell_scores, levels, ("g",), itself)
        assert {(r["g"], r["level"]): r["w"] for r in got.groupBy("g", "level").agg(F.sum("weight").alias("w")).collect()} == want
        assert {t for _, t in want} == {0.0, *levels}


def test_a_cell_is_scored_in_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    value, w = rnd.integers(0, 40, 30).astype(float), rnd.integers(1, 5, 30)
    table = lambda at: pa.table({"v": value[at], "_w": w[at], "_own": w[at] * (w[at] - 1) // 2})
    scores = lambda a, b: lambda i, j: 1 - np.abs(np.subtract.outer(a["v"].to_numpy()[i], b["v"].to_numpy()[j])) / 40
    few = slice(0, 12), slice(12, 30)
    for together in (1, 100, 1 << 18):
        monkeypatch.setattr(blocking, "TOGETHER", together)
        whole = blocking.counted_pairs(table(slice(None)), table(slice(None)), True, scores, [0.5, 0.9])
        parts = [blocking.counted_pairs(table(a), table(b), a is b, scores, [0.5, 0.9]) for a, b in ((few[0], few[0]), few, (few[1], few[1]))]
        rows = np.repeat(value, w)
        far = (1 - np.abs(np.subtract.outer(rows, rows)) / 40)[np.triu_indices(len(rows), 1)]
        assert whole == [sum(x) for x in zip(*parts, strict=True)] == [int((far < 0.5).sum()), int(((far >= 0.5) & (far < 0.9)).sum()), int((far >= 0.9).sum())]


def test_text_scores_in_tables():
    from kindred.functions import similarity as S

    assert S.levenshtein_all(["kitten", "", "a", ""], ["sitting", "ab", "a", ""]).tolist() == [1 - 3 / 7, 0.0, 1.0, 0.0]
    got = S.in_table(["civic", None, ""], ["civic", "accord", "", None], S.affine_gap_all)
    assert got[0, 0] == S.affine_gap("civic", "civic") and got[0, 1] == S.affine_gap("accord", "civic") and (got[1:] == 1).all() and (got[:, 2:] == 1).all()
