import functools
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.operators import learn, profile, serialize
from kindred.sources import files


def plain_gap(a, b):
    """Every alignment, by recursion: the last step is a pair, or a gap that opens or goes on."""
    if not a or not b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a

    @functools.cache
    def cost(i, j, state):
        if i == 0 and j == 0:
            return 0.0 if state == "pair" else math.inf
        options = [math.inf]
        if state == "pair" and i and j:
            options += [min(cost(i - 1, j - 1, s) for s in ("pair", "down", "right")) + (1.0 if a[i - 1] == b[j - 1] else 11.0)]
        if state == "down" and i:
            options += [cost(i - 1, j, "down") + 7.0, min(cost(i - 1, j, s) for s in ("pair", "right")) + 10.0]
        if state == "right" and j:
            options += [cost(i, j - 1, "right") + 7.0, min(cost(i, j - 1, s) for s in ("pair", "down")) + 10.0]
        return min(options)

    return min(cost(len(a), len(b), s) for s in ("pair", "down", "right")) / (len(a) + len(b))


def test_affine_gap_is_the_cheapest_alignment():
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
    for a, b in ((text(), text()) for _ in range(150)):
        assert S.affine_gap(a, b) == pytest.approx(plain_gap(a, b)), (a, b)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        label = i % 4 == 0
        price = rng.uniform(1000, 30000)
        other = price * (1 + rng.uniform(0, 0.02)) if label else rng.uniform(1000, 30000)
        rows.append((str(i), "honda", "civic", 2010.0, price, 5.0, f"x{i}", "honda", "civic" if label else rng.choice(["accord", "focus", None]), 2010.0 if label else 2000.0, other, 5.0, int(label)))
    sides = [f"d_{c}_{k} {t}" for k in (1, 2) for c, t in (("make", "string"), ("model", "string"), ("year", "double"), ("price", "double"), ("mileage", "double"))]
    return spark.createDataFrame(rows, ", ".join(["id1 string", *sides[:5], "id2 string", *sides[5:], "label int"]))


def test_scores_are_the_logistic_of_the_saved_coefficients(spark, pairs, tmp_path):
    model = learn.fit(pairs, "P1_full")
    learn.save(model, str(tmp_path / "model"))
    last = learn.load(str(tmp_path / "model")).stages[-1]
    assert last.getRegParam() in learn.PENALTIES
    names = learn.feature_names("P1_full")
    rows = learn.score(learn.load(str(tmp_path / "model")), pairs, "P1_full").select("label", "p", *names).collect()
    for r in rows:
        z = last.intercept + sum(w * r[c] for w, c in zip(last.coefficients, names, strict=True))
        assert r["p"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    from pyspark.ml.functions import vector_to_array

    loaded = learn.load(str(tmp_path / "model")).transform(learn.pair_features(pairs, "P1_full")).select("id1", vector_to_array("probability")[1].alias("p"))
    mine = {r["id1"]: r["p"] for r in learn.score(model, pairs, "P1_full").collect()}
    assert all(mine[r["id1"]] == pytest.approx(r["p"], abs=1e-12) for r in loaded.collect())
    assert sum((r["p"] >= 0.5) == bool(r["label"]) for r in rows) > 380


def test_report_counts_what_the_scores_say(spark):
    rows = [("e", 0.45, 1), ("e", 0.55, 0), ("e", 0.7, 1), ("f", 0.1, 0)]
    named = learn.report(spark.createDataFrame([("P1_full_B2", 0.5, 1)], "experiment string, p double, truth int")).first()
    assert (named["pipeline"], named["blocking"]) == ("P1_full", "B2")
    got = {(r["experiment"], r["threshold"]): tuple(r)[4:] for r in learn.report(spark.createDataFrame(rows, "experiment string, p double, truth int")).collect()}
    assert got[("e", 0.4)] == (2 / 3, 1.0, 0.8, 3) and got[("e", 0.5)] == (0.5, 0.5, 0.5, 3) and got[("e", 0.6)] == (1.0, 0.5, 2 / 3, 3)
    assert got[("f", 0.4)] == (0.0, 0.0, 0.0, 1)


def test_matcher_report_has_a_row_for_a_missing_run(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\tb\t1\na\tc\t0\n")
    (tmp_path / "p.jsonl").write_text('{"match": 1}\n{"match": 1}\n')
    runs = [("B1", str(tmp_path / "l.txt"), str(tmp_path / "p.jsonl"), "24m", "0m 2s"), ("B2", str(tmp_path / "l.txt"), str(tmp_path / "none"), "25m", "4m 38s")]
    got = {r["pipeline"]: tuple(r)[1:] for r in serialize.matcher_report(spark, runs).collect()}
    assert got == {"B1": ("2", "0.5", "1.0", "0.6667", "1.0", "0", "0", "24m", "0m 2s"), "B2": ("N/A",) * 7 + ("25m", "4m 38s")}


def test_scorer_hook_and_lines(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "a", 1), ("a", "b", 0)], "text_1 string, text_2 string, label int")
    assert {r["text_2"]: r["p"] for r in serialize.scored_by(pairs, lambda x, y: pd.Series((x == y).astype(float))).collect()} == {"a": 1.0, "b": 0.0}
    files.write_lines(spark.createDataFrame([("x\ty\t1",)], "value string"), str(tmp_path / "lines"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["x\ty\t1"]


def test_one_json_object_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('v"1', ["2", "1"]), ("w]: [", ["3"]), ("a", [])], "vin string, ids array<string>")
    files.write_json_object(df, str(tmp_path / "m"))
    text = "".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    assert json.loads(text) == {'v"1': ["2", "1"], "w]: [": ["3"], "a": []}
    assert sorted(map(tuple, files.read_json_map(spark, str(tmp_path / "m")).collect())) == [('v"1', "1", 2), ('v"1', "2", 1), ("w]: [", "3", 1)]


def test_both_zeros_are_one_value(spark):
    assert profile.profile(spark.createDataFrame([(0.0,), (-0.0,)], "x double")).first()["n_uniq"] == 1
    assert profile.profile(spark.range(3).select(F.lit(1.5).alias("x"))).first()["n_uniq"] == 1


def test_folds_keep_entities_apart(spark, pairs):
    owned = pairs.withColumns({"vins_1": F.array(F.concat(F.lit("v"), (F.col("id1").cast("int") % 30).cast("string"))), "vins_2": F.when(F.col("label") == 1, F.col("vins_1")).otherwise(F.lit(None).cast("array<string>"))})
    owned = owned.withColumn("vins_2", F.when(F.col("label") == 1, F.col("vins_1")).otherwise(F.col("vins_2")))
    rows = learn.with_folds(owned).select("id1", "id2", "vins_1", "vins_2", "fold_1", "fold_2").collect()
    fold = {}
    for r in rows:
        for vins, i, f in ((r["vins_1"], r["id1"], r["fold_1"]), (r["vins_2"], r["id2"], r["fold_2"])):
            assert fold.setdefault(vins[0] if vins else i, f) == f and 0 <= f < learn.FOLDS
    assert set(fold.values()) == set(range(learn.FOLDS))


def test_search_takes_the_penalty_with_the_best_f1(spark, pairs, monkeypatch):
    monkeypatch.setattr(learn, "fold_f1", lambda features, penalty, fold: {0.001: 0.5, 0.01: 0.8, 0.1: [0.8, None, 0.8][fold]}[penalty])
    assert learn.search(None) == {0.001: 0.5, 0.01: pytest.approx(0.8), 0.1: pytest.approx(0.8)}
    model = learn.fit(pairs, "P2_minimal")
    assert model.stages[-1].getRegParam() == 0.1


def test_fold_f1_counts(spark):
    rows = [(1, 0, 0, [5.0]), (0, 0, 0, [0.0]), (1, 1, 1, [5.0]), (0, 1, 1, [0.0]), (1, 1, 1, [0.1]), (0, 0, 1, [9.0]), (1, 2, 2, [1.0])]
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(y, a, b, Vectors.dense(x)) for y, a, b, x in rows], ["label", "fold_1", "fold_2", "features"])
    assert learn.fold_f1(df, 0.01, 1) == pytest.approx(2 / 3)
    assert learn.fold_f1(df.where("fold_1 <> 1"), 0.01, 1) is None and learn.fold_f1(df.where("fold_1 > 0"), 0.01, 1) is None


def test_every_test_pair_is_scored(spark, monkeypatch):
    """Blocks over the quick test's limits are scored too, and what the fit sees is bounded."""
    rows = [(f"{i:04d}", "honda", "civic" if i % 2 else "accord", 2018.0, 1000.0 + i % 50, 5.0, ("train", "test")[i % 2], i, f"k{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, make string, model string, year double, price double, mileage double, split string, ord long, row_key string")
    from kindred.operators import blocking

    typed = learn.records(df, order=learn.ORDER)
    known = blocking.entities_of(df.select(F.concat(F.lit("v"), (F.col("ord") % 100).cast("string")).alias("vin"), "id"))
    test = learn.test_pairs(learn.members(df, typed, known, blocking.B1, "test"), blocking.B1)
    assert test.agg(F.count("*"), F.sum("truth")).first()[:] == (500 * 499 // 2, 50 * 45)
    train = learn.train_pairs(learn.members(df, typed, known, blocking.B1, "train"), blocking.B1, most={1: 300, 0: 700})
    assert {r["label"]: r["count"] for r in train.groupBy("label").count().collect()} == {1: 300, 0: 700}
    assert train.select("id1", "id2").distinct().count() == 1000


def test_rows_are_drawn_without_their_records(spark, monkeypatch):
    """What is written and joined for the draw has ids, order and keys alone: records and lists of entities meet the drawn pairs, which are bounded."""
    from kindred.operators import blocking

    rows = [(f"{i:04d}", "honda", 2018.0, i, bytes([i % 256, i // 256])) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, make string, year double, ord long, key binary").withColumns({"fuel_type": F.lit("x"), "transmission": F.lit("y")})
    own = df.select(F.concat(F.lit("v"), (F.col("ord") % 100).cast("string")).alias("vin"), "id")
    kept = {}
    monkeypatch.setattr(learn, "written", lambda x, name: kept.setdefault(name, x.localCheckpoint()))
    inside = blocking.block_members(df, blocking.B1, order=("ord", "key"))
    pairs = learn.drawn_pairs(inside, df.join(blocking.entities_of(own), "id", "left"), blocking.B1, most={1: 300, 0: 700})
    assert {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()} == {1: 300, 0: 700}
    assert pairs.where("label <> CAST(CAST(id1 AS INT) % 100 = CAST(id2 AS INT) % 100 AS INT)").count() == 0
    assert set(kept["owned"].columns) == {"id", "ord", "key", "k_make", "k_year", "_vin", "pos", "block_size"}
    assert kept["drawn"].count() <= 2 * learn.OVER * 1000 and kept["facts"].count() <= 600


def test_pairs_counted_by_kinds_are_the_pairs_scored_one_by_one(spark):
    """Ids with several rows, ids of several entities, entities that are there twice and missing values; most rows are like others."""
    from kindred.operators import blocking

    rng = random.Random(3)
    ids = [f"{rng.randrange(70):03d}" for _ in range(120)]
    facts = {i: (rng.choice(["honda", "hondaa"]), rng.choice(["civic", "accord", None]), rng.choice([2018.0, 2001.0, None]), rng.choice([None, 0.0, 1000.0, 1500.0]), rng.choice([5.0, None])) for i in set(ids)}
    rows = [(i, *facts[i], "test", k, f"k{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id string, make string, model string, year double, price double, mileage double, split string, ord long, row_key string")
    owned = [(f"v{v}", i) for i in set(ids) for v in rng.sample(range(6), rng.choice([0, 1, 1, 2, 3])) for _ in range(rng.choice([1, 1, 2]))]
    known = blocking.entities_of(spark.createDataFrame(owned, "vin string, id string"))
    train = spark.createDataFrame([("a", "civic", 1), ("b", "accord", 0)] * 20, "x string, y string, label int")
    sides = {f"d_{c}_{i}": F.lit(v) for i in (1, 2) for c, v in (("make", "honda"), ("year", 2018.0), ("price", 1000.0), ("mileage", 5.0))}
    train = train.withColumns(sides).withColumns({"d_model_1": F.lit("civic"), "d_model_2": F.col("y"), "id1": F.monotonically_increasing_id().cast("string"), "id2": F.lit("0")})
    keys = ("make",)
    inside = learn.members(df, learn.records(df, order=learn.ORDER), known, keys, "test")
    for name, model in (("P1_full", learn.fit(train, "P1_full", penalties=(0.01,))), ("P2_minimal", None)):
        one, many = (f(model, inside, name, f"{name}_X", keys) for f in (learn.scores, learn.weighted_scores))
        want, got = (sorted(map(tuple, learn.report(x).collect())) for x in (one, many))
        assert got == want and len(got) == 3
        assert one.agg(F.sum("truth")).first()[0] == many.where("truth = 1").agg(F.sum("weight")).first()[0] > 100
        assert many.where("truth = 0 AND weight > 0").count() < one.count() / 2


def test_numbers_of_texts_put_pairs_in_the_order_of_their_lines(spark):
    for texts in (["a", "a b", "a\x01", "", "é", "a!", "b"], ["x", "x\ty", "x\t\x01", "w"]):
        rows = spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts * 2)], "id string, text string")
        numbered, order = serialize.with_text_numbers(rows)
        side = lambda i: numbered.select(*(F.col(c).alias(f"{c}_{i}") for c in ("text", "text_no")))
        pairs = side(1).crossJoin(side(2)).withColumn("label", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("value", serialize.line())
        got = [r["value"] for r in pairs.orderBy(*order).collect()]
        assert len(got) == 8 * len(texts) ** 2 and got == sorted(got, key=lambda x: x.encode())
        assert (order == ["value"]) == any("\t" in t for t in texts)


def test_cells_have_the_probabilities_of_the_pairs(spark, monkeypatch):
    """Models with weights for all that may be missing; the kinds of a block are dealt out in several cells, and of all pairs only counts are rows."""
    from kindred.operators import blocking

    monkeypatch.setattr(blocking, "CELL", 16)
    rng = random.Random(8)
    kinds = [(rng.choice(["honda", "hondaa", None]), rng.choice(["civic", "accord", None]), rng.choice([2018.0, 0.0]), rng.choice([0.0, 1000.0, 1500.0, 90.5]), rng.choice([5.0, 50.0, 0.0])) for _ in range(80)]
    inside = spark.createDataFrame([("x", f"{i:03d}", i + 1, 80, *k, ["v"] if i % 9 == 0 else None, False) for i, k in enumerate(kinds)], "k_make string, id string, pos int, block_size long, d_make string, d_model string, d_year double, d_price double, d_mileage double, vins array<string>, twice boolean")

    class Last:
        intercept = 1.25
        coefficients = [-0.9, 0.4, -0.7, -0.3, -1.1, 0.2, -0.6, 0.5, -3.0, 0.1]

    class Model:
        stages = [Last]

    one, many = (f(Model, inside, "P1_full", "P1_full_X", ("make",)) for f in (learn.scores, learn.weighted_scores))
    want, got = (sorted(map(tuple, learn.report(x).collect())) for x in (one, many))
    assert got == want and len({r[4] for r in got}) > 1
    assert many.where("truth = 0 AND weight > 0").count() <= 4 * 15  # cells; as pairs of kinds, over a thousand
    assert {r["p"] for r in many.where("truth = 0 AND weight > 0").select("p").distinct().collect()} == {0.0, *learn.THRESHOLDS}
