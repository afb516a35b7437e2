import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import normalize as N
from kindred.functions import similarity as S
from kindred.functions import vin as V
from kindred.operators import identity


def values(spark, kind, rows, make):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(make(F.col("x"))).collect()]


def model(v):
    """The check digit rule, in plain Python."""
    letters = dict(zip(V.LETTERS, map(int, V.VALUES), strict=True)) | {str(d): d for d in range(10)}
    if len(v) != 17 or any(c not in letters for c in v):
        return False
    rest = sum(letters[c] * w for c, w in zip(v, V.WEIGHTS, strict=True)) % 11
    return v[8] == ("X" if rest == 10 else str(rest))


def test_check_digit(spark):
    vins = ["1M8GDM9AXKP042788", "1HGCM82633A004352", "1HGCM82643A004352", "1HGCM82633AOO4352", "1HGCM82633A00435", "", None, "1HGCM8263àA004352", "11111111111111111"]
    vins += ["1HGCM826" + c + "3A004352" for c in "0123456789X"]
    assert values(spark, "string", vins, V.checksum_ok) == [bool(v) and model(v) for v in vins]


def test_status_rows(spark):
    rows = [
        ("1M8GDM9AXKP042788", 2000.0, "valid", "1M8GDM9AXKP042788"), ("1hgcm-82633-a004352", 2000.0, "valid", "1HGCM82633A004352"), ("1HGCM82633AOO4352", 2000.0, "repaired", "1HGCM82633A004352"),
        ("1HGCM82643A004352", 2000.0, "dropped", "1HGCM82643A004352"), ("1HGCM82633A00435", 2000.0, "ambiguous", "1HGCM82633A00435"), (None, 2000.0, "dropped", None), ("", 2000.0, "dropped", None),
        ("none", 2000.0, "dropped", None), ("N/A", 2000.0, "dropped", None), ("11111111111111111", 2000.0, "dropped", None), ("000CM82633A004352", 2000.0, "dropped", None),
        ("1HGXXX2633A004352", 2000.0, "dropped", None), ("12345678901234567", 2000.0, "dropped", None), ("ABCDEFGHJKLMNPRST", 2000.0, "dropped", None), ("1HGCM82633A004352", None, "valid", "1HGCM82633A004352"),
    ]
    df = spark.createDataFrame([(i, v, y) for i, (v, y, _, _) in enumerate(rows)], "i int, Vin string, year double")
    legacy, rest = identity.legacy_split(identity.with_plausible_vin(df))
    assert legacy.count() == 0
    got = {r["i"]: (r["Vin_status"], r["Vin"]) for r in identity.with_status(rest).collect()}
    assert got == {i: (s, v) for i, (_, _, s, v) in enumerate(rows)}
    assert identity.cleaned(df).count() == 4


def test_legacy_takes_old_rows_with_a_number_only(spark):
    df = spark.createDataFrame([("1M8GDM9AXKP042788", 1975.0), (None, 1975.0), ("1M8GDM9AXKP042788", None), ("1M8GDM9AXKP042788", 1981.0)], "Vin string, year double")
    legacy, rest = identity.legacy_split(df)
    assert (legacy.count(), rest.count()) == (1, 3)


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ABCDEFGHJKLMNPRSTUVWXYZ0123456789", min_size=17, max_size=17))
def test_repair_and_digit_model(v):
    fixed = [v[:8] + c + v[9:] for c in "0123456789X"]
    assert sum(map(model, fixed)) == 1
    assert v.translate(str.maketrans("IOQ", "100")) == v


def test_block_keys(spark):
    assert values(spark, "string", [" Honda\t", None, "Unknown", "\n a b "], N.block_key) == ["honda", "unknown", "unknown", "a b"]
    year = lambda c: N.block_key(c, True, "double")
    assert values(spark, "double", [2018.0, None, 12345678.0], year) == ["2018", "unknown", "12345678"]
    assert values(spark, "string", ["2018.05"], lambda c: N.block_key(c, True)) == ["20185"]
    assert values(spark, "double", [2018.0, None], lambda c: N.rule_year(c, "double")) == ["2018", "0"]


def test_tolerant_values(spark):
    assert values(spark, "string", ["1.5", "abc", None, ""], N.tolerant_double) == [1.5, None, None, None]
    assert values(spark, "string", ["NaN", "2", None], N.zero_filled) == [0.0, 2.0, 0.0]
    assert values(spark, "string", ["  X ", "", "\t"], N.clean_text) == ["x", None, None]
    assert values(spark, "string", ["3m 55s", "24m", None, "xm ys"], N.duration_seconds) == [235, None, None, None]
    assert values(spark, "double", [1e7, 2.5, -3.0], lambda c: N.text_of(c, "double")) == ["10000000.0", "2.5", "-3.0"]


def test_similarities(spark):
    df = spark.createDataFrame([("abcd", "abce", 1.0, 1.1), ("", "", 1.0, 1.0), (None, "a", None, 1.0), ("same", "same", 5.0, 5.2)], "a string, b string, x double, y double")
    rows = df.select(S.levenshtein_similarity(F.col("a"), F.col("b")), S.exact(F.col("a"), F.col("b")), F.round(S.linear(F.col("x"), F.col("y")), 6), S.missing(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in rows] == [(0.75, 0.0, 0.5, 0.0), (0.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 0.0, 0.0)]
    far = spark.createDataFrame([(10.0, 1000.0), (0.0, 5.0)], "x double, y double").select(S.log_distance(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in far] == [2.0, None]


@pytest.mark.parametrize(("a", "b", "score"), [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("JELLYFISH", "SMELLYFISH", 0.896296), ("", "", 0.0), ("a", "b", 0.0), ("abc", "abc", 1.0)])
def test_jaro_winkler(a, b, score):
    assert round(S.jaro_winkler(a, b), 6) == score


def test_affine_gap_orders_texts():
    assert S.affine_gap("honda civic", "honda civic") < S.affine_gap("honda civic", "honda civ") < S.affine_gap("honda civic", "ford focus")
    assert S.affine_gap("ab", "xyz") == S.affine_gap("xyz", "ab")


def test_dictionary_scores_each_pair_once_and_keeps_rows(spark):
    df = spark.createDataFrame([(1, "MARTHA", "MARHTA"), (2, "MARHTA", "MARTHA"), (3, "x", "x"), (4, "", ""), (5, None, "x")], "i int, a string, b string")
    got = {r["i"]: round(r["s"], 6) for r in S.by_dictionary(df, "a", "b", "s", S.jaro_winkler_all).collect()}
    assert got == {1: 0.961111, 2: 0.961111, 3: 1.0, 4: 0.0, 5: 0.0}


def test_texts_of_doubles_and_stripping(spark):
    xs = [0.0, -0.0, 1e-3, 9.99e-4, 1e-7, 0.1 + 0.2, 1 / 3, 9999999.5, 12345.678901, 12345.6789012, -5.25, 123456789.125, 2018.0, 104.05, None]
    want = ["0.0", "0.0", "0.001", "0.000999", "0.", "0.3", "0.333333", "9999999.5", "12345.678901", "12345.678901", "-5.25", "123456789.125", "2018.0", "104.05", None]
    assert values(spark, "double", xs, lambda c: N.text_of(c, "double")) == want
    # White space before a last line separator is inside the text; a regular expression took it for its end.
    texts = [" a b ", "\ta\n", "\x0b\f\r x\r\n", "", "  ", None, " é ", "x \u2028"]
    assert values(spark, "string", texts, N.stripped) == ["a b", "a", "x", "", "", None, "é", "x \u2028"]


def test_common_doubles_need_no_decimal(spark):
    df = spark.createDataFrame([(2.5,), (7.0,)], "x double").select(F.col("x"))
    plan = df.select(N.stripped(N.text_of(F.col("x"), "double")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(x" in plan and plan.index("as string") < plan.index("decimal") and "RegExpReplace(^" not in plan and "^\\s+" not in plan
