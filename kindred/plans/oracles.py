"""The library's queries in DuckDB's SQL, built up from common table expressions like the steps they check."""

from __future__ import annotations

from kindred.plans.standin import MEDIATED_SQL

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_YEAR = "CAST(year AS VARCHAR)"
_KEY = {
    "make": _STRIP.format("lower(coalesce(make, 'unknown'))"),
    "fuel_type": _STRIP.format("lower(coalesce(fuel_type, 'unknown'))"),
    "transmission": _STRIP.format("lower(coalesce(transmission, 'unknown'))"),
    "year": f"replace({_STRIP.format(f'lower(coalesce({_YEAR}, {chr(39)}unknown{chr(39)}))')}, '.0', '')",
}
_STRATEGIES = {"B1": ("make", "year"), "B2": ("make", "fuel_type", "transmission", "year")}


def _checksum(v: str) -> str:
    digits = f"translate({v}, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')"
    total = " + ".join(f"TRY_CAST(substr({digits}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)))
    return f"""coalesce(CASE WHEN length({v}) = 17 AND regexp_full_match({v}, '[A-Z0-9]+') AND NOT regexp_matches({v}, '[IOQ]')
      THEN substr({v}, 9, 1) = CASE WHEN ({total}) % 11 = 10 THEN 'X' ELSE CAST(({total}) % 11 AS VARCHAR) END END, false)"""


_STEPS = {
    "normal": """SELECT *, CASE WHEN n NOT IN ('NONE','NAN','NULL','UNKNOWN','EMPTY','0','X','ANY') THEN n END AS nvin
      FROM (SELECT *, regexp_replace(upper(raw_vin), '[^A-Z0-9]', '', 'g') AS n FROM mediated)""",
    "judged": """SELECT *, coalesce(nvin = '' OR len(list_distinct(string_split(nvin, ''))) < 4 OR contains(nvin, 'XXX') OR starts_with(nvin, '000')
      OR regexp_full_match(nvin, '[0-9]+') OR regexp_full_match(nvin, '[A-Z]+'), true) AS bad FROM normal""",
    "plausible": """SELECT *, CASE WHEN NOT bad THEN nvin END AS pvin FROM judged""",
    "dated": """SELECT *, coalesce(year < 1981 AND pvin IS NOT NULL, false) AS is_legacy FROM plausible""",
    "stated": f"""SELECT *, CASE WHEN pvin IS NULL THEN 'dropped'
      WHEN length(pvin) = 17 AND regexp_matches(pvin, '[IOQ]') THEN CASE WHEN {_checksum("rvin")} THEN 'repaired' ELSE 'dropped' END
      WHEN length(pvin) = 17 THEN CASE WHEN {_checksum("pvin")} THEN 'valid' ELSE 'dropped' END ELSE 'ambiguous' END AS vin_status
      FROM (SELECT *, translate(pvin, 'IOQ', '100') AS rvin FROM dated WHERE NOT is_legacy)""",
    "cleaned": """SELECT *, CASE WHEN vin_status = 'repaired' THEN rvin ELSE pvin END AS vin, listing_id AS id FROM stated WHERE vin_status IN ('valid', 'repaired')""",
    "members": """SELECT * FROM (SELECT vin, id, row_number() OVER (PARTITION BY vin ORDER BY ord, row_key) AS pos, count(*) OVER (PARTITION BY vin) AS n FROM cleaned) WHERE n > 1""",
    "id2vin": """SELECT id, max(vin) AS vin FROM members GROUP BY id""",
    "splits": """SELECT vin, CASE WHEN r <= n - nr THEN 'train' WHEN r <= n - ceil(round(0.5 * nr, 6)) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT vin, r, n, ceil(round(0.3 * n, 6)) AS nr FROM (SELECT vin, row_number() OVER (ORDER BY md5(concat_ws('|', '42', vin)), vin) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT vin FROM members)))""",
    "positives": """SELECT vin, id1, id2 FROM (SELECT a.vin, a.id AS id1, b.id AS id2, row_number() OVER (PARTITION BY a.vin ORDER BY a.pos, b.pos) AS rn
      FROM members a JOIN members b ON a.vin = b.vin AND a.pos < b.pos) WHERE rn <= 10""",
    "placed": """SELECT split, id1, id2 FROM positives JOIN splits USING (vin)""",
    "numbered_rows": """SELECT row_number() OVER (ORDER BY md5(concat_ws('|', ord, row_key)), ord, row_key) AS r, c.id, v.vin FROM cleaned c LEFT JOIN id2vin v ON c.id = v.id""",
    "tries": """SELECT s.split, s.seed, a.attempt, s.n,
        CAST(concat('0x', substr(md5(concat_ws('|', s.seed, a.attempt, 'a')), 1, 8)) AS BIGINT) % t.total + 1 AS r1,
        CAST(concat('0x', substr(md5(concat_ws('|', s.seed, a.attempt, 'b')), 1, 8)) AS BIGINT) % t.total + 1 AS r2
      FROM (SELECT split, count(*) AS n, CASE split WHEN 'train' THEN 42 WHEN 'val' THEN 43 ELSE 44 END AS seed FROM placed GROUP BY split) s
      CROSS JOIN (SELECT count(*) AS total FROM cleaned) t
      JOIN (SELECT unnest(range(1, 1 + 5 * (SELECT count(*) FROM placed))) AS attempt) a ON a.attempt <= 5 * s.n""",
    "negatives": """SELECT split, id1, id2 FROM (SELECT t.split, t.n, a.id AS id1, b.id AS id2, row_number() OVER (PARTITION BY t.split ORDER BY t.attempt) AS rn
      FROM tries t JOIN numbered_rows a ON a.r = t.r1 JOIN numbered_rows b ON b.r = t.r2 WHERE t.r1 <> t.r2 AND a.vin IS DISTINCT FROM b.vin) WHERE rn <= n""",
    "labelled": """SELECT split, id1, id2, 1 AS label FROM placed UNION ALL SELECT split, id1, id2, 0 AS label FROM negatives""",
    "assigned": """SELECT c.*, coalesce(list_extract(['train', 'val', 'test'], r), 'exclude') AS split FROM cleaned c
      LEFT JOIN (SELECT id, max(CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END) AS r
        FROM (SELECT id1 AS id, split FROM labelled UNION ALL SELECT id2, split FROM labelled) GROUP BY id) p ON c.id = p.id""",
    "texts": """SELECT id, text FROM (SELECT id, {text} AS text, row_number() OVER (PARTITION BY id ORDER BY ord DESC, row_key DESC) AS rn FROM cleaned) WHERE rn = 1""",
    "truth": """SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM members a JOIN members b ON a.vin = b.vin AND a.pos < b.pos""",
}
_FIELDS = ("make", "model", "year", "price", "mileage", "fuel_type", "transmission", "body_type", "drive", "color", "engine_cylinders", "latitude", "longitude")
_text = lambda c: f"CAST({c} AS VARCHAR)"
_STEPS["texts"] = _STEPS["texts"].format(text=" || ' ' || ".join(f"'COL {c} VAL ' || " + _STRIP.format(f"lower(coalesce({_text(c)}, ''))") for c in _FIELDS))
_ORDER = list(_STEPS)


def _with(last: str, more: str = "") -> str:
    """The chain of steps up to `last`, and further ones."""
    steps = _ORDER[: _ORDER.index(last) + 1] if last else []
    return "WITH " + ",\n".join([MEDIATED_SQL, *(f"{s} AS ({_STEPS[s]})" for s in steps)]) + (",\n" + more if more else "") + "\n"


def _keys(names: tuple[str, ...]) -> str:
    return ", ".join(f"{_KEY[c]} AS k_{c}" for c in names)


def _names(names: tuple[str, ...], alias: str = "") -> str:
    return ", ".join(f"{alias}k_{c}" for c in names)


def _same(names: tuple[str, ...], extra: tuple[str, ...] = ()) -> str:
    return " AND ".join(f"a.{c} = b.{c}" for c in (*extra, *(f"k_{n}" for n in names)))


def _blocks(names: tuple[str, ...]) -> str:
    return _with("cleaned", f"keyed AS (SELECT id, {_keys(names)} FROM cleaned)") + f"SELECT {_names(names)}, count(*) AS n FROM keyed GROUP BY {_names(names)} HAVING count(*) >= 2"


_RULES = f"""rules AS (SELECT * FROM (SELECT id, {_STRIP.format("lower(coalesce(make, ''))")} AS make, {_STRIP.format("lower(coalesce(model, ''))")} AS model,
   {_STRIP.format(f"replace(coalesce({_YEAR}, '0'), '.0', '')")} AS year, price, mileage, row_number() OVER (PARTITION BY id ORDER BY ord, row_key) AS rn FROM cleaned) WHERE rn = 1)"""


def _scored(name: str, gate: str = "AND a.size < 200") -> str:
    keys = _STRATEGIES[name]
    linear = lambda c: f"CASE WHEN x.{c} IS NULL OR y.{c} IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - abs(x.{c} - y.{c}) / 0.2::DOUBLE) END"
    return f"""keyed_{name} AS (SELECT split, id, {_keys(keys)}, ord, row_key FROM assigned WHERE split <> 'exclude'),
  sized_{name} AS (SELECT *, count(*) OVER (PARTITION BY split, {_names(keys)}) AS size FROM keyed_{name}),
  pairs_{name} AS (SELECT a.split, a.id AS id1, b.id AS id2 FROM sized_{name} a JOIN sized_{name} b ON {_same(keys, ("split",))} WHERE a.id < b.id AND a.size >= 2 {gate}),
  feat_{name} AS (SELECT p.*, CASE WHEN greatest(length(x.make), length(y.make)) > 0 AND 1 - levenshtein(x.make, y.make)::DOUBLE / greatest(length(x.make), length(y.make)) >= 0.85::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_make,
    CASE WHEN x.model <> '' AND y.model <> '' AND jaro_winkler_similarity(x.model, y.model) >= 0.85::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_model,
    CASE WHEN x.year = y.year THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_year, {linear("price")} AS f_price, {linear("mileage")} AS f_mileage,
    CASE WHEN v.vin = w.vin THEN 1 ELSE 0 END AS truth
    FROM pairs_{name} p JOIN rules x ON x.id = p.id1 JOIN rules y ON y.id = p.id2 LEFT JOIN id2vin v ON v.id = p.id1 LEFT JOIN id2vin w ON w.id = p.id2),
  scored_{name} AS (SELECT *, '{name}' AS strategy, (f_make * 2 + f_model * 4 + f_year * 2 + f_price * 1 + f_mileage * 1) / 10 AS score FROM feat_{name})"""


def _both(gate: str = "AND a.size < 200") -> str:
    return f"{_RULES},\n{_scored('B1', gate)},\n{_scored('B2', gate)},\nboth_ AS (SELECT split, strategy, score, truth FROM scored_B1 UNION ALL SELECT split, strategy, score, truth FROM scored_B2)"


_BOTH = _both()
_CELLS = "cells AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) s(split) CROSS JOIN (VALUES ('B1'), ('B2')) k(strategy))"
_LOSS = "lost AS (" + " UNION ALL ".join(f"""SELECT split, '{name}' AS strategy, count(*) AS dropped_blocks, sum(pairs) AS dropped_pairs, sum(truths) AS dropped_true_pairs FROM
  (SELECT split, sum(m) * (sum(m) - 1) // 2 - sum(same) AS pairs, sum(CASE WHEN vin IS NULL THEN 0 ELSE m * (m - 1) // 2 - same END) AS truths, sum(m) AS n
    FROM (SELECT split, {", ".join(f"k_{c}" for c in keys)}, vin, sum(k) AS m, sum(k * (k - 1) // 2) AS same
      FROM (SELECT split, {", ".join(f"{_KEY[c]} AS k_{c}" for c in keys)}, v.vin, a.id, count(*) AS k FROM assigned a LEFT JOIN id2vin v ON v.id = a.id WHERE split <> 'exclude' GROUP BY ALL) GROUP BY ALL)
    GROUP BY split, {", ".join(f"k_{c}" for c in keys)}) WHERE n >= 200 GROUP BY split""" for name, keys in _STRATEGIES.items()) + ")"


def _swept(thresholds: str) -> str:
    return f"""counted AS (SELECT split, strategy, threshold, count(*) AS n, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp,
      count(*) FILTER (score < threshold AND truth = 1) AS fn FROM both_ CROSS JOIN (SELECT unnest([{thresholds}]::DOUBLE[]) AS threshold) GROUP BY ALL),
    rated AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM counted),
    swept AS (SELECT split, strategy, threshold, n AS candidates, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM rated)"""


_SWEEP = _swept("0.70, 0.75, 0.80, 0.85, 0.90")
_PROFILED = ("Vin", "listing_id", "make", "model", "year", "price", "mileage", "fuel_type", "transmission", "body_type", "drive", "condition", "color", "engine_cylinders", "latitude", "longitude", "description", "listing_date", "source")
_column = lambda c: "raw_vin" if c == "Vin" else c
_MEDIATED_OUT = ", ".join(f"{_column(c)} AS {c.lower()}" for c in _PROFILED)
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, row_key DESC) AS rn FROM cleaned) WHERE rn = 1"

#: Entities of each id, and whether a pair of ids is one of an entity's.
_ENTITIES = "entities AS (SELECT id, list_sort(list(vin)) AS vins, max(k) > 1 AS twice FROM (SELECT id, vin, count(*) AS k FROM members GROUP BY ALL) GROUP BY id)"
_LABEL = "CASE WHEN CASE WHEN id1 = id2 THEN coalesce(x.twice, false) ELSE coalesce(list_has_any(x.vins, y.vins), false) END THEN 1 ELSE 0 END"


def _test_rows(keys: tuple[str, ...]) -> str:
    return f"(SELECT id, {_keys(keys)}, row_number() OVER (PARTITION BY {', '.join(_KEY[c] for c in keys)} ORDER BY ord, row_key) AS pos FROM assigned WHERE split = 'test')"


def _drawn(name: str, rows: str, by: str, wanted: int) -> str:
    """About `wanted` pairs of the rows (by, id, pos, n, ord, row_key) of groups, by hash, or all of them if there are no more."""
    columns = [c.strip() for c in by.split(",")]
    same = " AND ".join(f"a.{c} = b.{c}" for c in columns)
    hashed = lambda *more: f"CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(('42', 'ord', 'row_key', *more))})), 1, 8)) AS BIGINT)"
    return f"""total_{name} AS (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS total FROM (SELECT DISTINCT {by}, n FROM {rows})),
      tries_{name} AS (SELECT {by}, id, pos, ord, row_key, unnest(range(1, 1 + CAST(floor((pos - 1) * ({wanted}::DOUBLE / total) + {hashed()} / 4294967296.0::DOUBLE) AS BIGINT))) AS d FROM {rows}, total_{name} WHERE pos > 1 AND total > {wanted}),
      drawn_{name} AS (SELECT DISTINCT {by}, id, pos, {hashed("d")} % (pos - 1) + 1 AS at FROM tries_{name}),
      pairs_{name} AS (SELECT a.id AS id1, b.id AS id2 FROM {rows} a JOIN {rows} b ON {same} AND a.pos < b.pos, total_{name} WHERE total <= {wanted}
        UNION ALL SELECT a.id, b.id FROM drawn_{name} b JOIN {rows} a ON {same} AND a.pos = b.at),
      marked_{name} AS (SELECT DISTINCT id1, id2, {_LABEL} AS label FROM pairs_{name} LEFT JOIN entities x ON x.id = id1 LEFT JOIN entities y ON y.id = id2)"""


def _train_pairs(strategy: str) -> str:
    keys = _STRATEGIES[strategy]
    by = _names(keys)
    return _with("assigned", f"""{_ENTITIES},
      keyed AS (SELECT id, ord, row_key, {_keys(keys)} FROM assigned WHERE split = 'train'),
      inside AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY ord, row_key) AS pos FROM keyed WINDOW w AS (PARTITION BY {by})) WHERE n > 1),
      each_vin AS (SELECT i.* EXCLUDE (n, pos), unnest(vins) AS v FROM inside i JOIN entities USING (id)),
      owned AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY ord, row_key) AS pos FROM each_vin WINDOW w AS (PARTITION BY {by}, v)) WHERE n > 1),
      {_drawn("different", "inside", by, 30000)},
      {_drawn("alike", "owned", by + ", v", 10000)},
      both_labels AS (SELECT * FROM marked_different WHERE label = 0 UNION ALL SELECT * FROM marked_alike WHERE label = 1)""") + """SELECT id1, id2, label FROM
      (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', id1, id2)), id1, id2) AS rn FROM both_labels) WHERE rn <= CASE label WHEN 1 THEN 5000 ELSE 15000 END"""


_TEST_LINES = _with("texts", f"""keyed AS (SELECT id, ord, row_key, {_keys(_STRATEGIES["B2"])} FROM assigned WHERE split = 'test'),
  sized AS (SELECT *, row_number() OVER (PARTITION BY {_names(_STRATEGIES["B2"])} ORDER BY ord, row_key) AS pos FROM keyed),
  pairs AS (SELECT a.id AS id1, b.id AS id2 FROM sized a JOIN sized b ON {_same(_STRATEGIES["B2"])} WHERE a.pos < b.pos),
  lines AS (SELECT x.text || chr(9) || y.text || chr(9) || CASE WHEN v.vin = w.vin THEN '1' ELSE '0' END AS value FROM pairs p JOIN texts x ON x.id = p.id1 JOIN texts y ON y.id = p.id2
    LEFT JOIN id2vin v ON v.id = p.id1 LEFT JOIN id2vin w ON w.id = p.id2)""")


def _matchers() -> str:
    """The stand-in matchers' answers by line: label lines and answers are numbered in the order of the lines, answers that can't be read left out."""
    begins = lambda xs: " OR ".join(f"starts_with(md5(value), '{x}')" for x in xs) or "false"
    seconds = {"careful": 235, "hasty": 0}
    answers, rows = "", []
    for name, flipped, lost in (("careful", ("0",), ("10", "11", "20")), ("hasty", ("0", "1", "2", "3"), ("40",))):
        answers += f""",
      p_{name} AS (SELECT row_number() OVER (ORDER BY value) AS line, CASE WHEN {begins(flipped)} THEN 1 - label ELSE label END AS m FROM labelled_lines WHERE NOT ({begins(lost)})),
      c_{name} AS (SELECT count(*) FILTER (m IS NOT NULL AND label IS NOT NULL) AS n, count(*) FILTER (m IS NULL) AS l, count(*) FILTER (label IS NULL) AS r, count(*) FILTER (m = 1 AND label = 1) AS tp,
        count(*) FILTER (m = 1 AND label = 0) AS fp, count(*) FILTER (m = 0 AND label = 1) AS fn FROM (SELECT label, m FROM labelled_lines FULL JOIN p_{name} USING (line)))"""
        speed = f"round(n / {seconds[name]}, 2)" if seconds[name] else "0.0::DOUBLE"
        measures = {"pairs": "n", "precision": "round(coalesce(tp / nullif(tp + fp, 0), 0), 4)", "recall": "round(coalesce(tp / nullif(tp + fn, 0), 0), 4)", "f1": "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4)", "throughput": speed, "labels_left": "l", "predictions_left": "r"}
        rows.append(f"SELECT '{name}' AS pipeline, " + ", ".join(f"CASE WHEN n > 0 THEN CAST({e} AS VARCHAR) ELSE 'N/A' END AS {k}" for k, e in measures.items()) + f" FROM c_{name}")
    rows.append("SELECT 'absent' AS pipeline, " + ", ".join(f"'N/A' AS {k}" for k in ("pairs", "precision", "recall", "f1", "throughput", "labels_left", "predictions_left")))
    return _TEST_LINES.rstrip() + ",\n      labelled_lines AS (SELECT value, CAST(right(value, 1) AS INT) AS label, row_number() OVER (ORDER BY value) AS line FROM lines)" + answers + "\n" + " UNION ALL ".join(rows)


SQL = {
    "profile_report": _with("") + "SELECT attr, round(100.0 * nulls / n, 2) AS null_pct, round(100.0 * u / n, 4) AS uniq_pct, u AS n_uniq, coalesce(round(100.0 * nulls / n, 2) > 70, false) AS drop_flag FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS attr, count(*) AS n, (count(*) - count({_column(c)}))::DOUBLE AS nulls, count(DISTINCT {_column(c)}) AS u FROM mediated" for c in _PROFILED) + ")",
    "mediate_union": _with("") + f"SELECT {_MEDIATED_OUT}, row_key FROM mediated",
    "vin_normalize": _with("normal") + "SELECT row_key, nvin AS vin FROM normal",
    "vin_implausible": _with("judged") + "SELECT row_key, nvin AS vin, bad AS flag FROM judged",
    "vin_checksum": _with("normal") + f"SELECT row_key, nvin AS vin, {_checksum('nvin')} AS flag FROM normal",
    "vin_status": _with("stated") + "SELECT row_key, CASE WHEN vin_status = 'repaired' THEN rvin ELSE pvin END AS vin, vin_status FROM stated",
    "legacy_partition": _with("dated") + "SELECT row_key, is_legacy FROM dated",
    "cleaned_listings": _with("cleaned") + "SELECT row_key, id, vin, vin_status FROM cleaned",
    "training_records": _with("cleaned") + "SELECT row_key, id, make, model, year, price, mileage, fuel_type, transmission, source FROM cleaned",
    "gt_map": _with("members") + "SELECT vin, count(*) AS n, arg_min(id, pos) AS first_id, arg_max(id, pos) AS last_id FROM members GROUP BY vin",
    "gt_clusters": _with("members") + "SELECT count(DISTINCT vin) AS n_clusters, count(*) AS n_members FROM members",
    "id_to_vin": _with("id2vin") + "SELECT id, vin FROM id2vin",
    "entity_split": _with("splits") + "SELECT vin, split FROM splits",
    "positive_pairs": _with("positives") + "SELECT id1, id2, 1 AS label FROM positives",
    "negative_pairs": _with("labelled") + "SELECT split, id1, id2, label FROM labelled WHERE label = 0",
    "split_assignment": _with("assigned") + "SELECT row_key, id, split FROM assigned",
    "blocks_b1": _blocks(_STRATEGIES["B1"]),
    "blocks_b2": _blocks(_STRATEGIES["B2"]),
    "blocks_by_split": _with("assigned") + " UNION ALL ".join(
        f"SELECT split, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_rows, '{name}' AS strategy FROM (SELECT split, {_keys(keys)}, count(*) AS n FROM assigned WHERE split <> 'exclude' GROUP BY ALL HAVING count(*) >= 2) GROUP BY split"
        for name, keys in _STRATEGIES.items()
    ),
    "candidates_lex": _with("cleaned", f"sized AS (SELECT *, count(*) OVER (PARTITION BY {_names(_STRATEGIES['B2'])}) AS size FROM (SELECT id, {_keys(_STRATEGIES['B2'])} FROM cleaned))")
    + f"SELECT a.id AS id1, b.id AS id2 FROM sized a JOIN sized b ON {_same(_STRATEGIES['B2'])} WHERE a.id < b.id AND a.size >= 2 AND a.size < 200",
    "candidates_all": _with("cleaned", f"sized AS (SELECT id, {_keys(_STRATEGIES['B2'])} FROM cleaned)") + f"SELECT a.id AS id1, b.id AS id2 FROM sized a JOIN sized b ON {_same(_STRATEGIES['B2'])} WHERE a.id < b.id",
    "candidates_pos": _with("cleaned", f"""keyed AS (SELECT id, ord, row_key, {_keys(_STRATEGIES["B2"])} FROM cleaned),
      sized AS (SELECT *, count(*) OVER w AS size, row_number() OVER (w ORDER BY ord, row_key) AS pos FROM keyed WINDOW w AS (PARTITION BY {_names(_STRATEGIES["B2"])})),
      firsts AS (SELECT {_names(_STRATEGIES["B2"])} FROM sized WHERE size >= 2 GROUP BY ALL ORDER BY ALL LIMIT 200),
      kept AS (SELECT * FROM sized SEMI JOIN firsts USING ({_names(_STRATEGIES["B2"])}) WHERE size >= 2 AND size < 301)""")
    + f"SELECT a.id AS id1, b.id AS id2 FROM kept a JOIN kept b ON {_same(_STRATEGIES['B2'])} WHERE a.pos < b.pos",
    "dedup_first": _with("cleaned") + "SELECT id, row_key, model, year, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, row_key) AS rn FROM cleaned) WHERE rn = 1",
    "dedup_last": _with("cleaned") + f"SELECT id, row_key, model, year, price FROM ({_LAST})",
    "limited_records": _with("cleaned") + f"SELECT row_key, nullif({_STRIP.format('lower(make)')}, '') AS make, price, coalesce(mileage, 0.0::DOUBLE) AS mileage FROM cleaned ORDER BY ord, row_key LIMIT 25000",
    "gt_pairs": _with("members", f"truth AS ({_STEPS['truth']})") + "SELECT a, b FROM truth",
    "sim_features": _with("assigned", f"{_RULES},\n{_scored('B2')}") + "SELECT id1, id2, f_make, f_model, f_year, round(f_price, 6) AS f_price, round(f_mileage, 6) AS f_mileage FROM scored_B2 WHERE split = 'test'",
    "rule_score": _with("assigned", f"{_RULES},\n{_scored('B2')}") + "SELECT id1, id2, round(score, 6) AS score, CAST(score >= 0.85::DOUBLE AS INT) AS pred, truth FROM scored_B2 WHERE split = 'test'",
    "rule_sweep": _with("assigned", f"{_BOTH},\n{_SWEEP}") + "SELECT split, strategy, threshold, precision, recall, f1 FROM swept",
    "rule_report": _with("assigned", f"{_BOTH},\n{_swept('0.85')},\n{_CELLS},\n{_LOSS}")
    + "SELECT split, strategy, coalesce(candidates, 0) AS candidates, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1, "
    + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("dropped_blocks", "dropped_pairs", "dropped_true_pairs")) + " FROM cells LEFT JOIN swept USING (split, strategy) LEFT JOIN lost USING (split, strategy)",
    "rule_report_all": _with("assigned", f"{_both('')},\n{_swept('0.85')},\n{_CELLS}")
    + "SELECT split, strategy, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("candidates", "tp", "fp", "fn", "precision", "recall", "f1")) + " FROM cells LEFT JOIN swept USING (split, strategy)",
    "best_threshold": _with("assigned", f"{_BOTH},\n{_SWEEP}") + """SELECT experiment, CASE WHEN f1 > 0 THEN threshold ELSE 0.0::DOUBLE END AS threshold, f1 FROM
      (SELECT concat_ws('_', split, strategy) AS experiment, threshold, f1, row_number() OVER (PARTITION BY split, strategy ORDER BY f1 DESC, threshold) AS rn FROM swept) WHERE rn = 1""",
    "serialize_records": _with("texts") + "SELECT id, text FROM texts",
    "serialize_pairs": _with("texts") + "SELECT a.text || chr(9) || b.text || chr(9) || CAST(l.label AS VARCHAR) AS value FROM labelled l JOIN texts a ON a.id = l.id1 JOIN texts b ON b.id = l.id2 WHERE l.split = 'train'",
    "serialize_test_pairs": _TEST_LINES + "SELECT value FROM lines",
    "matcher_eval": _matchers(),
    "log_price_features": _with("labelled", f"last_ AS ({_LAST})") + "SELECT l.id1, l.id2, l.label, " + ", ".join(
        f"CASE WHEN a.{c} > 0 AND b.{c} > 0 THEN round(abs(log10(a.{c}) - log10(b.{c})), 6) END AS g_{c}" for c in ("price", "mileage", "year")
    ) + ", " + ", ".join(f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m_{c}" for c in ("price", "mileage"))
    + " FROM labelled l JOIN last_ a ON a.id = l.id1 JOIN last_ b ON b.id = l.id2 WHERE l.split = 'train'",
    "jaro_winkler_names": "WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 6) AS s FROM n x JOIN n y ON x.a < y.a",
    "train_pairs_sampled": _train_pairs("B2"),
    "train_pairs_b1": _train_pairs("B1"),
    "supervised_pairs": _with("assigned", f"{_ENTITIES},\n" + ",\n".join(f"""pairs_{name} AS (SELECT a.id AS id1, b.id AS id2 FROM {_test_rows(keys)} a JOIN {_test_rows(keys)} b ON {_same(keys)} WHERE a.pos < b.pos),
      marked_{name} AS (SELECT {_LABEL} AS label FROM pairs_{name} LEFT JOIN entities x ON x.id = id1 LEFT JOIN entities y ON y.id = id2)""" for name, keys in _STRATEGIES.items()))
    + " UNION ALL ".join(f"SELECT '{name}' AS strategy, count(*) AS test_pairs, CAST(coalesce(sum(label), 0) AS BIGINT) AS true_pairs FROM marked_{name}" for name in _STRATEGIES),
}
