"""The registered queries as SQL over the raw test tables.

Each statement derives the seven tables first and then states the result on
its own terms, so that it checks both the mapping and the operators.
"""

from __future__ import annotations

MAPPING = """
WITH team AS (
  SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation
),
season AS (
  SELECT CAST(row_number() OVER (ORDER BY yr) AS INT) AS id, yr AS year
  FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS yr FROM orders) y
),
ml_model AS (
  SELECT DISTINCT l_linenumber AS id, concat('model_', CAST(l_linenumber AS VARCHAR)) AS name,
    CASE WHEN l_linenumber % 2 = 1 THEN 'margin' ELSE 'win_probability' END AS predictionType
  FROM lineitem
),
ml_model_season AS (
  SELECT CAST(s.id * 10 + m.id AS INT) AS id,
    m.id = 1 + 2 * (s.year % 4) AS isPrincipal,
    (m.id = 1 + 2 * (s.year % 4) OR m.id = 2 + 2 * (s.year % 3)) AS isUsedInCompetitions,
    s.id AS seasonId, m.id AS mlModelId
  FROM season s CROSS JOIN ml_model m
),
match AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS id, o.o_orderdate AS startDateTime,
    CAST(floor((dayofyear(o.o_orderdate) - 1) / 14) AS INT) + 1 AS roundNumber,
    CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
         ELSE concat('venue_', CAST(o.o_custkey % 20 AS VARCHAR)) END AS venue,
    CASE WHEN o.o_orderstatus = 'P' THEN NULL
         ELSE CAST(floor(o.o_totalprice / 10000) AS INT) END AS margin,
    CASE WHEN o.o_orderstatus = 'P' OR floor(o.o_totalprice / 10000) = 0 THEN NULL
         WHEN o.o_orderstatus = 'F' THEN CAST(c.c_nationkey AS INT)
         ELSE CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS INT) END AS winnerId,
    s.id AS seasonId,
    CAST(c.c_nationkey AS INT) AS homeId,
    CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS INT) AS awayId
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN season s ON CAST(year(o.o_orderdate) AS INT) = s.year
),
team_match AS (
  SELECT id * 2 AS id, true AS atHome,
    CAST(60 + id % 40 + CASE WHEN winnerId = homeId THEN margin ELSE 0 END AS INT) AS score,
    id AS matchId, homeId AS teamId
  FROM match WHERE margin IS NOT NULL
  UNION ALL
  SELECT id * 2 + 1 AS id, false AS atHome,
    CAST(60 + id % 40 + CASE WHEN winnerId = awayId THEN margin ELSE 0 END AS INT) AS score,
    id AS matchId, awayId AS teamId
  FROM match WHERE margin IS NOT NULL
),
prediction AS (
  SELECT m.id * 10 + l.mlModelId AS id,
    CASE WHEN l.mlModelId % 2 = 1 THEN l.qty END AS predictedMargin,
    m.id AS matchId, l.mlModelId,
    CASE WHEN l.pk % 3 < 2 THEN m.homeId ELSE m.awayId END AS predictedWinnerId,
    CASE WHEN m.margin IS NULL THEN NULL
         ELSE coalesce(CASE WHEN l.pk % 3 < 2 THEN m.homeId ELSE m.awayId END = m.winnerId, false)
         END AS isCorrect,
    CASE WHEN l.mlModelId % 2 = 0 THEN 0.5E0 + 4E0 * l.disc END AS predictedWinProbability,
    m.startDateTime AS createdAt, m.startDateTime AS updatedAt
  FROM (SELECT l_orderkey, l_linenumber AS mlModelId, min(l_quantity) AS qty,
               min(l_partkey) AS pk, max(l_discount) AS disc
        FROM lineitem GROUP BY l_orderkey, l_linenumber) l
  JOIN match m ON m.id = l.l_orderkey
)"""

SCORED = """,
scored AS (
  SELECT s.year, m.seasonId, m.roundNumber, p.matchId, p.mlModelId, l.name,
    CAST(p.isCorrect AS INT) AS tip,
    abs(p.predictedMargin - CASE WHEN m.margin IS NULL THEN NULL
                                 WHEN m.winnerId IS NULL THEN 0
                                 WHEN m.winnerId = p.predictedWinnerId THEN m.margin
                                 ELSE -m.margin END) AS absError,
    CASE WHEN m.margin IS NULL THEN NULL
         WHEN m.winnerId IS NULL
           THEN 1 + 0.5 * log2(p.predictedWinProbability * (1 - p.predictedWinProbability))
         WHEN m.winnerId = p.predictedWinnerId THEN 1 + log2(p.predictedWinProbability)
         ELSE 1 + log2(1 - p.predictedWinProbability) END AS bits,
    f.isPrincipal, f.isUsedInCompetitions
  FROM prediction p
  JOIN match m ON m.id = p.matchId
  JOIN season s ON s.id = m.seasonId
  LEFT JOIN ml_model l ON l.id = p.mlModelId
  JOIN ml_model_season f ON f.seasonId = m.seasonId AND f.mlModelId = p.mlModelId
)"""

SEASON_METRICS = """,
season_metrics AS (
  SELECT year,
    CAST(sum(tip) FILTER (WHERE isPrincipal) AS BIGINT) AS totalTips,
    avg(tip) FILTER (WHERE isPrincipal) AS accuracy,
    avg(absError) FILTER (WHERE isUsedInCompetitions) AS mae,
    sum(bits) FILTER (WHERE isUsedInCompetitions) AS bits
  FROM scored GROUP BY year
)"""

CUMULATIVE = """,
cells AS (
  SELECT year, roundNumber, name FROM scored GROUP BY ALL
),
round_scores AS (
  SELECT c.year, c.roundNumber, c.name,
    CAST(sum(s.tip) AS DOUBLE) AS totalTips, avg(s.tip) AS accuracy,
    avg(s.absError) AS mae, sum(s.bits) AS bits
  FROM cells c
  JOIN scored s ON s.year = c.year AND s.name = c.name AND s.roundNumber <= c.roundNumber
  GROUP BY ALL
)"""

PER_ROUND = """,
round_scores AS (
  SELECT year, roundNumber, name,
    CAST(sum(tip) AS DOUBLE) AS totalTips, avg(tip) AS accuracy,
    avg(absError) AS mae, sum(bits) AS bits
  FROM scored GROUP BY ALL
)"""

COMBINED = """,
principal AS (
  SELECT p.*, m.seasonId, m.roundNumber, s.year
  FROM prediction p
  JOIN match m ON m.id = p.matchId
  JOIN season s ON s.id = m.seasonId
  JOIN ml_model_season f ON f.seasonId = m.seasonId AND f.mlModelId = p.mlModelId
  WHERE f.isPrincipal
),
secondary AS (
  SELECT p.*
  FROM prediction p
  JOIN match m ON m.id = p.matchId
  JOIN ml_model_season f ON f.seasonId = m.seasonId AND f.mlModelId = p.mlModelId
  WHERE f.isUsedInCompetitions AND NOT f.isPrincipal
),
round_predictions AS (
  SELECT a.year, a.roundNumber, a.matchId, t.name AS predictedWinnerName,
    coalesce(a.predictedMargin,
             CASE WHEN b.predictedWinnerId = a.predictedWinnerId THEN b.predictedMargin
                  ELSE -b.predictedMargin END) AS predictedMargin,
    coalesce(a.predictedWinProbability,
             CASE WHEN b.predictedWinnerId = a.predictedWinnerId THEN b.predictedWinProbability
                  ELSE 1 - b.predictedWinProbability END) AS predictedWinProbability,
    a.isCorrect
  FROM principal a
  LEFT JOIN secondary b ON b.matchId = a.matchId
  LEFT JOIN team t ON t.id = a.predictedWinnerId
)"""

PREDICTED_YEARS = """,
predicted_years AS (
  SELECT DISTINCT CAST(year(m.startDateTime) AS INT) AS year
  FROM match m JOIN prediction p ON p.matchId = m.id
)"""

# Model usage handed to the backfill queries: name, year, both flags.
USAGE = (
    ("model_1", 1996, True, True),
    ("model_3", 1997, True, True),
    ("model_5", 1998, True, True),
    ("model_6", 1998, False, True),
    ("model_7", 1999, True, True),
    ("model_7", 2000, True, True),
    ("model_2", 1999, False, True),
)


def fixed_point(value: str, digits: int) -> str:
    """Fixed-point text. ``printf`` rounds exact ties to even; they go away from
    zero here. A tie is an odd multiple of a power of two, which is exact to test."""
    scaled = f"(abs({value}) * {2 ** (digits + 1)})"
    tie = f"{scaled} = floor({scaled}) AND {scaled} % 2 = 1"
    nudged = f"{value} + sign({value}) * 1e-{digits + 3}"
    return f"printf('%.{digits}f', CASE WHEN {tie} THEN {nudged} ELSE {value} END)"


def number_text(value: str, digits: int = 0) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'NA' ELSE {fixed_point(value, digits)} END"


def percent_text(value: str, digits: int = 2) -> str:
    text = fixed_point(f"({value} * 100e0)", digits)
    return f"CASE WHEN {value} IS NULL THEN 'NA' ELSE concat({text}, '%') END"


def _round_metric(metric: str, scores: str) -> str:
    return (
        MAPPING + SCORED + scores + f"\nSELECT year, roundNumber, name, round({metric}, 6) AS value"
        "\nFROM round_scores"
    )


_REFERENCES = """,
held AS (
  SELECT 'Match.winnerId' AS relation, 'team' AS parent, CAST(winnerId AS BIGINT) AS key FROM match
  UNION ALL SELECT 'Match.seasonId', 'season', seasonId FROM match
  UNION ALL SELECT 'Prediction.matchId', 'match', matchId FROM prediction
  UNION ALL SELECT 'Prediction.mlModelId', 'ml_model', mlModelId FROM prediction
  UNION ALL SELECT 'Prediction.predictedWinnerId', 'team', predictedWinnerId FROM prediction
  UNION ALL SELECT 'TeamMatch.matchId', 'match', matchId FROM team_match
  UNION ALL SELECT 'TeamMatch.teamId', 'team', teamId FROM team_match
  UNION ALL SELECT 'MlModelSeason.seasonId', 'season', seasonId FROM ml_model_season
  UNION ALL SELECT 'MlModelSeason.mlModelId', 'ml_model', mlModelId FROM ml_model_season
)"""

_USAGE_ROWS = ", ".join(
    f"('{name}', {year}, {str(p).lower()}, {str(c).lower()})" for name, year, p, c in USAGE
)

_WIDE = ",\n  ".join(
    f"max(round(totalTips, 6)) FILTER (WHERE name = 'model_{n}') AS model_{n}" for n in range(1, 8)
)
_WIDE_MAE = ",\n  ".join(
    f"max(round(mae, 6)) FILTER (WHERE name = 'model_{n}') AS model_{n}" for n in range(1, 8)
)

_REQUIRED = {
    "Match": ("match", ["id", "startDateTime", "roundNumber"]),
    "Prediction": (
        "prediction",
        ["id", "matchId", "mlModelId", "predictedWinnerId", "createdAt", "updatedAt"],
    ),
    "TeamMatch": ("team_match", ["id", "atHome", "score", "matchId", "teamId"]),
    "Season": ("season", ["id", "year"]),
    "Team": ("team", ["id", "name"]),
    "MlModel": ("ml_model", ["id", "name", "predictionType"]),
    "MlModelSeason": (
        "ml_model_season",
        ["id", "isPrincipal", "isUsedInCompetitions", "seasonId", "mlModelId"],
    ),
}
_NULLS = "\nUNION ALL ".join(
    f"SELECT '{label}' AS tableName, '{column}' AS columnName, "
    f"CAST(count(*) - count({column}) AS BIGINT) AS nulls FROM {table}"
    for label, (table, columns) in _REQUIRED.items()
    for column in columns
)
# The mapping sets the two old flags to a constant.
_NULLS += "\nUNION ALL SELECT 'MlModel', 'isPrincipal', 0"
_NULLS += "\nUNION ALL SELECT 'MlModel', 'usedInCompetitions', 0"

_UNIQUE = {
    "Match": ("match", "startDateTime, venue", "startDateTime IS NOT NULL AND venue IS NOT NULL"),
    "MlModel": ("ml_model", "name", "name IS NOT NULL"),
    "MlModelSeason": (
        "ml_model_season",
        "seasonId, mlModelId",
        "seasonId IS NOT NULL AND mlModelId IS NOT NULL",
    ),
    "Team": ("team", "name", "name IS NOT NULL"),
    "Season": ("season", "year", "year IS NOT NULL"),
}
_UNIQUE_SQL = "\nUNION ALL ".join(
    f"SELECT '{label}' AS tableName, count(*) AS repeatedKeys, "
    f"CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM {table} "
    f"WHERE {condition} GROUP BY {keys} HAVING count(*) > 1) r"
    for label, (table, keys, condition) in _UNIQUE.items()
)
_PRIMARY_SQL = "\nUNION ALL ".join(
    f"SELECT '{label}' AS tableName, "
    f"(SELECT count(*) FROM (SELECT id FROM {table} WHERE id IS NOT NULL GROUP BY id "
    f"HAVING count(*) > 1) r) AS repeatedKeys, "
    f"CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {table} "
    f"WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) r) AS BIGINT) AS rows, "
    f"(SELECT count(*) FROM {table} WHERE id IS NULL) AS nullKeys"
    for label, (table, _) in _REQUIRED.items()
)

_CURRENT = """,
latest AS (SELECT max(year) AS year FROM season)"""

# How a value is written for a fingerprint, by kind.
_CANONICAL = {
    "plain": "CAST({0} AS VARCHAR)",
    "double": "CAST(CAST(round({0} * 1000000) AS DECIMAL(38, 0)) AS VARCHAR)",
    "time": "CAST(epoch_us(CAST({0} AS TIMESTAMP)) AS VARCHAR)",
    "text": "concat(strlen({0}), ':', {0})",
}
_FINGERPRINTED = {
    "match": ("Match", "id startDateTime:time roundNumber venue:text margin winnerId seasonId"),
    "prediction": (
        "Prediction",
        "id predictedMargin:double matchId mlModelId predictedWinnerId isCorrect "
        "predictedWinProbability:double createdAt:time updatedAt:time",
    ),
    "team_match": ("TeamMatch", "id atHome score matchId teamId"),
    "season": ("Season", "id year"),
    "team": ("Team", "id name:text"),
    "ml_model": ("MlModel", "id name:text NULL false predictionType:text false"),
    "ml_model_season": ("MlModelSeason", "id isPrincipal isUsedInCompetitions seasonId mlModelId"),
}


def _fingerprint(table: str, source: str) -> str:
    label, columns = _FINGERPRINTED[table]
    texts = []
    for column in columns.split():
        name, _, kind = column.partition(":")
        value = _CANONICAL[kind or "plain"].format(name)
        texts.append(f"CASE WHEN {name} IS NULL THEN '-null-' ELSE {value} END")
    text = f"concat_ws('|', {', '.join(texts)})"
    return f"""SELECT '{label}' AS tableName, count(*) AS rows,
  CAST(coalesce(sum(CAST('0x' || substr(md5({text}), 1, 16) AS UBIGINT)), 0) AS VARCHAR) AS checksum
FROM {source}"""


_FINGERPRINTS = "\n" + "\nUNION ALL ".join(_fingerprint(t, t) for t in _FINGERPRINTED)
# A database holds one match per start and venue, and what belongs to those.
_KEPT = """,
kept_match AS (
  SELECT * FROM match
  QUALIFY venue IS NULL OR id = min(id) OVER (PARTITION BY startDateTime, venue)
),
kept_prediction AS (SELECT * FROM prediction WHERE matchId IN (SELECT id FROM kept_match)),
kept_team_match AS (SELECT * FROM team_match WHERE matchId IN (SELECT id FROM kept_match))
"""
_KEPT_FINGERPRINTS = "\nUNION ALL ".join(
    _fingerprint(t, f"kept_{t}" if t in ("match", "prediction", "team_match") else t)
    for t in _FINGERPRINTED
)

ORACLES: dict[str, str] = {
    "season_metrics": MAPPING + SCORED + SEASON_METRICS + """
SELECT year, totalTips, round(accuracy, 6) AS accuracy, round(mae, 6) AS mae,
  round(bits, 6) AS bits
FROM season_metrics""",
    "scored_predictions": MAPPING + SCORED + """
SELECT year, roundNumber, matchId, mlModelId, tip, round(absError, 6) AS absError,
  round(bits, 6) AS bits
FROM scored""",
    "round_total_tips": _round_metric("totalTips", CUMULATIVE),
    "round_accuracy": _round_metric("accuracy", CUMULATIVE),
    "round_mae": _round_metric("mae", CUMULATIVE),
    "round_bits": _round_metric("bits", CUMULATIVE),
    "round_total_tips_per_round": _round_metric("totalTips", PER_ROUND),
    "round_accuracy_per_round": _round_metric("accuracy", PER_ROUND),
    "round_mae_per_round": _round_metric("mae", PER_ROUND),
    "round_bits_per_round": _round_metric("bits", PER_ROUND),
    "round_metrics_wide": MAPPING + SCORED + CUMULATIVE + f"""
SELECT year, roundNumber,
  {_WIDE}
FROM round_scores GROUP BY year, roundNumber""",
    "metric_series": MAPPING + SCORED + CUMULATIVE + f"""
SELECT roundNumber,
  {_WIDE_MAE}
FROM round_scores WHERE year = 1999 GROUP BY roundNumber""",
    "round_predictions": MAPPING + COMBINED + """
SELECT year, roundNumber, matchId, predictedWinnerName,
  round(predictedMargin, 6) AS predictedMargin,
  round(predictedWinProbability, 6) AS predictedWinProbability, isCorrect
FROM round_predictions""",
    "prediction_list": MAPPING + COMBINED + """
SELECT predictedWinnerName, round(predictedMargin, 6) AS predictedMargin,
  round(predictedWinProbability, 6) AS predictedWinProbability, isCorrect
FROM round_predictions WHERE year = 1999 AND roundNumber = 5""",
    "round_report": MAPPING + COMBINED + f"""
SELECT year, roundNumber, matchId, predictedWinnerName AS winner,
  {number_text('predictedMargin', 2)} AS margin,
  {percent_text('predictedWinProbability')} AS probability,
  CASE WHEN isCorrect IS NULL THEN 'dunno' WHEN isCorrect THEN 'yeah' ELSE 'nah' END AS correct
FROM round_predictions""",
    "season_report": MAPPING + SCORED + SEASON_METRICS + f"""
SELECT year, 1 AS position, 'Total Tips' AS label,
  {number_text('CAST(totalTips AS DOUBLE)')} AS text FROM season_metrics
UNION ALL SELECT year, 2, 'Accuracy', {percent_text('accuracy')} FROM season_metrics
UNION ALL SELECT year, 3, 'MAE', {number_text('mae', 2)} FROM season_metrics
UNION ALL SELECT year, 4, 'Bits', {number_text('bits', 2)} FROM season_metrics""",
    "prediction_texts": MAPPING + f"""
SELECT id, {number_text('predictedMargin', 2)} AS margin,
  {number_text('predictedMargin')} AS wholeMargin,
  {number_text('(predictedMargin / 8)', 2)} AS marginEighth,
  {percent_text('predictedWinProbability')} AS probability,
  {percent_text('predictedWinProbability', 0)} AS axisProbability
FROM prediction""",
    "seasons": MAPPING + "\nSELECT year FROM season",
    "predicted_rounds": MAPPING + """
SELECT DISTINCT s.year, m.roundNumber
FROM match m JOIN prediction p ON p.matchId = m.id JOIN season s ON s.id = m.seasonId""",
    "latest_rounds": MAPPING + """
SELECT s.year, max(m.roundNumber) AS roundNumber
FROM match m JOIN prediction p ON p.matchId = m.id JOIN season s ON s.id = m.seasonId
GROUP BY s.year""",
    "report_titles": MAPPING + """
SELECT s.year, concat('Model performance for ', s.year) AS seasonTitle,
  concat('Predictions for Round ', max(m.roundNumber), ', ', s.year) AS roundTitle
FROM match m JOIN prediction p ON p.matchId = m.id JOIN season s ON s.id = m.seasonId
GROUP BY s.year""",
    "current_season_default": MAPPING + _CURRENT + "\nSELECT year FROM latest",
    "current_season_requested": MAPPING + _CURRENT + """
SELECT coalesce((SELECT year FROM season WHERE year = 1997), (SELECT year FROM latest)) AS year""",
    "predicted_years": MAPPING + PREDICTED_YEARS + "\nSELECT year FROM predicted_years",
    "season_backfill": MAPPING + PREDICTED_YEARS + """,
new_season AS (
  SELECT CAST(row_number() OVER (ORDER BY year) AS INT) AS id, year FROM predicted_years
)
SELECT m.id AS matchId, n.id AS seasonId, n.year
FROM match m
LEFT JOIN new_season n
  ON m.startDateTime >= make_timestamp(n.year, 1, 1, 0, 0, 0)
 AND m.startDateTime < make_timestamp(n.year + 1, 1, 1, 0, 0, 0)""",
    "ml_model_season_backfill": MAPPING + PREDICTED_YEARS + f""",
new_season AS (
  SELECT CAST(row_number() OVER (ORDER BY year) AS INT) AS id, year FROM predicted_years
),
usage AS (
  SELECT * FROM (VALUES {_USAGE_ROWS}) u(name, year, isPrincipal, isUsedInCompetitions)
)
SELECT CAST((n.id - 1) * (SELECT max(id) FROM ml_model) + m.id AS INT) AS id,
  coalesce(u.isPrincipal, false) AS isPrincipal,
  coalesce(u.isUsedInCompetitions, false) AS isUsedInCompetitions,
  n.id AS seasonId, m.id AS mlModelId
FROM new_season n CROSS JOIN ml_model m
LEFT JOIN usage u ON u.name = m.name AND u.year = n.year""",
    "models_in_use": MAPPING + """
SELECT s.year, l.name, f.isPrincipal, f.isUsedInCompetitions
FROM ml_model_season f JOIN season s ON s.id = f.seasonId JOIN ml_model l ON l.id = f.mlModelId
WHERE f.isPrincipal OR f.isUsedInCompetitions""",
    "series_colours": MAPPING + SCORED + """,
palette AS (
  SELECT * FROM (VALUES (1, '#E69F00'), (2, '#56B4E9'), (3, '#CC79A7'), (4, '#009E73'),
    (5, '#0072B2'), (6, '#D55E00'), (7, '#F0E442')) p(series, colour)
),
numbered AS (
  SELECT year, name, CAST(row_number() OVER (PARTITION BY year ORDER BY name) AS INT) AS series
  FROM (SELECT DISTINCT year, name FROM scored) d
)
SELECT n.year, n.series, n.name, p.colour FROM numbered n LEFT JOIN palette p USING (series)""",
    "ranked_models": MAPPING + SCORED + CUMULATIVE + f"""
SELECT year, roundNumber,
  CAST(row_number() OVER (PARTITION BY year, roundNumber
                          ORDER BY coalesce(totalTips, 0) DESC, name) AS INT) AS position,
  name, totalTips AS value, {number_text('totalTips')} AS text
FROM round_scores""",
    "metric_texts": MAPPING + SCORED + CUMULATIVE + f"""
SELECT year, roundNumber, name, 'Accuracy' AS label, {percent_text('accuracy', 0)} AS axis,
  {percent_text('accuracy', 2)} AS tooltip FROM round_scores
UNION ALL SELECT year, roundNumber, name, 'MAE', {number_text('mae', 0)},
  {number_text('mae', 2)} FROM round_scores
UNION ALL SELECT year, roundNumber, name, 'Total Tips', {number_text('totalTips', 0)},
  {number_text('totalTips', 0)} FROM round_scores""",
    "dup_match_key": MAPPING + """
SELECT strftime(startDateTime, '%Y-%m-%d %H:%M:%S') AS startDateTime, venue, count(*) AS rows
FROM match WHERE venue IS NOT NULL
GROUP BY ALL HAVING count(*) > 1""",
    "unique_keys": MAPPING + "\n" + _UNIQUE_SQL,
    "primary_keys": MAPPING + "\n" + _PRIMARY_SQL,
    "null_required": MAPPING + "\n" + _NULLS,
    "orphan_refs": MAPPING + _REFERENCES + """
SELECT h.relation, h.key, count(*) AS rows
FROM held h
WHERE h.key IS NOT NULL
  AND NOT (h.parent = 'team' AND EXISTS (SELECT 1 FROM team t JOIN nation n ON n.n_nationkey = t.id
                                         WHERE t.id = h.key AND n.n_regionkey <> 2))
  AND NOT (h.parent = 'season' AND EXISTS (SELECT 1 FROM season s WHERE s.id = h.key))
  AND NOT (h.parent = 'match' AND EXISTS (SELECT 1 FROM match m WHERE m.id = h.key))
  AND NOT (h.parent = 'ml_model' AND EXISTS (SELECT 1 FROM ml_model l WHERE l.id = h.key))
GROUP BY h.relation, h.key""",
    "references_held": MAPPING + _REFERENCES + """
SELECT relation, key, count(*) AS rows FROM held WHERE key IS NOT NULL GROUP BY relation, key""",
    "principal_per_season": MAPPING + """
SELECT s.year, count(*) FILTER (WHERE f.isPrincipal) AS principals,
  count(*) FILTER (WHERE f.isPrincipal) <= 1 AS isValid
FROM season s LEFT JOIN ml_model_season f ON f.seasonId = s.id GROUP BY s.year""",
    "repeated_predictions": MAPPING + """,
doubled AS (SELECT l_orderkey AS matchId, l_linenumber AS mlModelId FROM lineitem)
SELECT matchId, mlModelId, count(*) AS rows FROM doubled GROUP BY ALL HAVING count(*) > 1""",
    "negative_margins": MAPPING + """
SELECT id, margin - 30 AS margin FROM match WHERE margin - 30 < 0""",
    "overlong_text": """
SELECT doc_id, CAST(length(text) AS INT) AS length FROM documents
WHERE length(text) > 100 OR length(source) > 100""",
    "delete_match_cascade": MAPPING + """,
gone AS (SELECT id FROM match WHERE margin = 0)
SELECT 'Match' AS tableName, id FROM match WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'Prediction', id FROM prediction WHERE matchId NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'TeamMatch', id FROM team_match WHERE matchId NOT IN (SELECT id FROM gone)""",
    "delete_team_set_null": MAPPING + """,
gone AS (SELECT CAST(n_nationkey AS INT) AS id FROM nation WHERE n_regionkey = 2)
SELECT m.id, CASE WHEN g.id IS NULL THEN m.winnerId END AS winnerId
FROM match m LEFT JOIN gone g ON g.id = m.winnerId""",
    "delete_season_set_null": MAPPING + """
SELECT m.id, CASE WHEN s.year >= 1998 THEN m.seasonId END AS seasonId
FROM match m LEFT JOIN season s ON s.id = m.seasonId""",
    "delete_model_restricted": MAPPING + """
SELECT 'Prediction.mlModelId' AS relation, CAST(p.mlModelId AS BIGINT) AS key, count(*) AS rows
FROM prediction p JOIN ml_model l ON l.id = p.mlModelId
WHERE l.predictionType = 'win_probability' GROUP BY ALL
UNION ALL
SELECT 'MlModelSeason.mlModelId', CAST(f.mlModelId AS BIGINT), count(*)
FROM ml_model_season f JOIN ml_model l ON l.id = f.mlModelId
WHERE l.predictionType = 'win_probability' GROUP BY ALL""",
    "remap_team_key": MAPPING + """,
key_map AS (SELECT id AS oldId, id + 100 AS newId FROM team WHERE id % 2 = 0)
SELECT 'Team' AS relation, CAST(coalesce(k.newId, t.id) AS BIGINT) AS rowId,
  coalesce(k.newId, t.id) AS key
FROM team t LEFT JOIN key_map k ON k.oldId = t.id
UNION ALL
SELECT 'Match.winnerId', m.id, coalesce(k.newId, m.winnerId)
FROM match m LEFT JOIN key_map k ON k.oldId = m.winnerId
UNION ALL
SELECT 'Prediction.predictedWinnerId', p.id, coalesce(k.newId, p.predictedWinnerId)
FROM prediction p LEFT JOIN key_map k ON k.oldId = p.predictedWinnerId
UNION ALL
SELECT 'TeamMatch.teamId', t.id, coalesce(k.newId, t.teamId)
FROM team_match t LEFT JOIN key_map k ON k.oldId = t.teamId""",
    "home_away_pairs": MAPPING + """
SELECT h.matchId, h.teamId AS homeTeamId, h.score AS homeScore,
  a.teamId AS awayTeamId, a.score AS awayScore
FROM team_match h JOIN team_match a ON a.matchId = h.matchId AND NOT a.atHome
WHERE h.atHome""",
    "recomputed_correctness": MAPPING + """
SELECT p.id, CASE WHEN m.margin IS NULL THEN NULL WHEN m.winnerId IS NULL THEN true
                  ELSE m.winnerId = p.predictedWinnerId END AS isCorrect
FROM prediction p LEFT JOIN match m ON m.id = p.matchId""",
    "evolve_schema": MAPPING + """
SELECT id, strftime(startDateTime, '%Y-%m-%d %H:%M:%S') AS startDateTime, roundNumber, venue,
  margin, winnerId
FROM match""",
    "evolve_prediction": MAPPING + """
SELECT id, predictedMargin, matchId, mlModelId, predictedWinnerId, isCorrect,
  round(predictedWinProbability, 6) AS predictedWinProbability
FROM prediction""",
    "insert_defaults": MAPPING + """
SELECT id, coalesce(CASE WHEN mlModelId % 2 = 1 THEN isPrincipal END, false) AS isPrincipal,
  false AS isUsedInCompetitions, seasonId, mlModelId
FROM ml_model_season""",
    "fact_keys": MAPPING + """
SELECT count(*) AS rows, count(*) AS keys, CAST(0 AS BIGINT) AS clashes FROM prediction""",
    "season_starts": MAPPING + """
SELECT year, strftime(make_timestamp(year, 1, 1, 0, 0, 0), '%Y-%m-%d %H:%M:%S') AS starts,
  strftime(make_timestamp(year + 1, 1, 1, 0, 0, 0), '%Y-%m-%d %H:%M:%S') AS ends
FROM season""",
    "matches_of_year": MAPPING + """
SELECT id FROM match WHERE year(startDateTime) = 1999""",
    "integer_prefixes": """
SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT) AS number
FROM orders""",
    "dashboard_document": MAPPING + SCORED + SEASON_METRICS + """,
parts AS (
  SELECT
    (SELECT string_agg(CAST(roundNumber AS VARCHAR), ',' ORDER BY roundNumber)
     FROM (SELECT DISTINCT roundNumber FROM scored WHERE year = 1999) r) AS rounds,
    (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM season) AS years,
    (SELECT totalTips FROM season_metrics WHERE year = 1999) AS totalTips
)
SELECT concat('[', rounds, ']') AS roundNumbers, totalTips, 1999 AS currentSeasonYear,
  concat('[', years, ']') AS seasonYears,
  (SELECT round(accuracy, 6) FROM season_metrics WHERE year = 1999) AS accuracy,
  (SELECT round(mae, 6) FROM season_metrics WHERE year = 1999) AS mae,
  (SELECT round(bits, 6) FROM season_metrics WHERE year = 1999) AS bits
FROM parts""",
    "round_predictions_orphans": MAPPING + COMBINED.replace(
        "LEFT JOIN team t ON t.id = a.predictedWinnerId",
        "LEFT JOIN (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 2) t "
        "ON t.id = a.predictedWinnerId",
    ) + """
SELECT year, roundNumber, matchId, predictedWinnerName,
  round(predictedMargin, 6) AS predictedMargin,
  round(predictedWinProbability, 6) AS predictedWinProbability, isCorrect
FROM round_predictions""",
    "recomputed_correctness_orphans": MAPPING + """
SELECT p.id, CASE WHEN m.margin IS NULL THEN NULL WHEN m.winnerId IS NULL THEN true
                  ELSE m.winnerId = p.predictedWinnerId END AS isCorrect
FROM prediction p LEFT JOIN match m ON m.id = p.matchId AND m.venue IS NOT NULL""",
    "metric_flags": """
SELECT o_orderkey, name, name IN ('totalTips', 'accuracy', 'mae', 'bits') AS isMetric
FROM (SELECT o_orderkey, unnest(['accuracy', 'Accuracy', 'bits', 'totalTips', 'mae ', '',
                                 lower(o_orderpriority)]) AS name FROM orders) o""",
    "parameter_rows": MAPPING + COMBINED + """,
shown AS (SELECT count(*) AS tips FROM round_predictions WHERE year = 1999 AND roundNumber = 5)
SELECT r.request, CASE WHEN r.request < 2 THEN shown.tips ELSE 0 END AS tips
FROM (SELECT CAST(unnest(range(6)) AS INT) AS request) r, shown""",
    "json_series": MAPPING + SCORED + CUMULATIVE + """
SELECT roundNumber,
  """ + ",\n  ".join(
        f"round(max(bits) FILTER (WHERE name = 'model_{n}'), 6) AS model_{n}" for n in range(1, 8)
    ) + """
FROM round_scores WHERE year = 1999 GROUP BY roundNumber""",
    "stored_rows": MAPPING + _FINGERPRINTS,
    "database_rows": MAPPING + _KEPT + _KEPT_FINGERPRINTS,
    "dense_fact_keys": MAPPING + """
SELECT count(*) AS rows, count(*) AS keys, (SELECT max(id) FROM match) + 1 AS firstKey,
  (SELECT max(id) FROM match) + count(*) AS lastKey
FROM prediction""",
    "merged_totals": MAPPING + SCORED + """,
cells AS (
  SELECT year, roundNumber, mlModelId, CAST(sum(tip) AS BIGINT) AS sumTip,
    sum(absError) AS sumAbsError, sum(bits) AS sumBits,
    count(tip) AS nTip, count(absError) AS nAbsError, count(bits) AS nBits
  FROM scored GROUP BY ALL
)
SELECT year, roundNumber, mlModelId, sumTip, round(sumAbsError, 6) AS sumAbsError,
  round(sumBits, 6) AS sumBits, nTip, nAbsError, nBits,
  CAST(sum(sumTip) OVER to_date AS BIGINT) AS sumTipToDate,
  round(sum(sumAbsError) OVER to_date, 6) AS sumAbsErrorToDate,
  round(sum(sumBits) OVER to_date, 6) AS sumBitsToDate
FROM cells
WINDOW to_date AS (PARTITION BY year, mlModelId ORDER BY roundNumber
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "season_documents": MAPPING + SCORED + SEASON_METRICS + """,
rounds AS (
  SELECT year, concat('[', string_agg(CAST(roundNumber AS VARCHAR), ',' ORDER BY roundNumber), ']')
    AS roundNumbers
  FROM (SELECT DISTINCT year, roundNumber FROM scored) r GROUP BY year
)
SELECT s.year, coalesce(r.roundNumbers, '[]') AS roundNumbers, m.totalTips,
  s.year AS currentSeasonYear,
  (SELECT concat('[', string_agg(CAST(year AS VARCHAR), ',' ORDER BY year), ']') FROM season)
    AS seasonYears,
  round(m.accuracy, 6) AS accuracy, round(m.mae, 6) AS mae, round(m.bits, 6) AS bits
FROM season s LEFT JOIN rounds r ON r.year = s.year LEFT JOIN season_metrics m ON m.year = s.year""",
    "stored_delete": MAPPING + SCORED + """,
gone AS (SELECT id FROM match WHERE margin = 0),
sides AS (
  SELECT m.seasonId, count(*) AS teamRows,
    CAST(sum(t.teamId + CASE WHEN t.teamId % 2 = 0 THEN 100 ELSE 0 END) AS BIGINT) AS teamIds
  FROM team_match t JOIN match m ON m.id = t.matchId
  WHERE t.matchId NOT IN (SELECT id FROM gone) GROUP BY m.seasonId
),
scores AS (
  SELECT s.year, s.seasonId, count(*) AS predictions,
    CAST(sum(p.predictedWinnerId + CASE WHEN p.predictedWinnerId % 2 = 0 THEN 100 ELSE 0 END)
         AS BIGINT) AS winners,
    round(sum(s.absError), 6) AS absError, round(sum(s.bits), 6) AS bits
  FROM scored s JOIN prediction p ON p.matchId = s.matchId AND p.mlModelId = s.mlModelId
  WHERE s.matchId NOT IN (SELECT id FROM gone) GROUP BY s.year, s.seasonId
)
SELECT c.year, teamRows, teamIds, predictions, winners, absError, bits
FROM scores c JOIN sides d ON d.seasonId = c.seasonId""",
    "refreshed_scores": MAPPING + SCORED + """
SELECT year, count(*) AS predictions, CAST(sum(tip) AS BIGINT) AS totalTips,
  round(sum(absError), 6) AS absError, round(sum(bits), 6) AS bits
FROM scored GROUP BY year""",
}
