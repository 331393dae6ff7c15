"""The same results in plain SQL, written another way: ntile instead of cutoffs, recursive tree walks
instead of compiled trees, unrolled epochs instead of training jobs."""

from __future__ import annotations

from shardwise.catalog.inputs import CLIENTS, FEATURES, TREES
from shardwise.config import LOG_METRICS, METRICS
from shardwise.operators.forest_fit import BINS, LEAST_GAIN, SAMPLE_ROWS, poisson_bounds

SQL: dict[str, str] = {}


def r6(expression: str, digits: int = 6) -> str:
    """Rounded; adding 0 turns a negative zero into zero."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"


def digest(purpose: str, *key: str) -> str:
    return f"md5(concat_ws('|', '42', '{purpose}', {', '.join(key)}))"


def with_(*tables: tuple[str, str]) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in tables) + "\n"


OBS = ("obs", """SELECT event_id, value, CAST(hour(ts) AS DOUBLE) AS hour, CAST(dayofweek(ts) + 1 AS DOUBLE) AS dow,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events""")
ORDERS = ("obs_orders", """SELECT o_orderkey AS order_id, o_totalprice AS price, CAST(month(o_orderdate) AS DOUBLE) AS month,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders""")


def part(clients: int = CLIENTS, source: str = "obs", name: str = "part") -> tuple[str, str]:
    return (name, f"""SELECT *, CAST(ntile({clients}) OVER (ORDER BY {digest('partition', 'event_id')}, event_id) - 1 AS INTEGER) AS client_id
  FROM {source}""")


def stratified(source: str, purpose: str = "stratify", name: str = "strat") -> tuple[tuple[str, str], ...]:
    """Split per client with class shares kept."""
    return (
        (f"{name}_n", f"SELECT client_id, label, count(*) AS n FROM {source} GROUP BY ALL"),
        (f"{name}_t", f"""SELECT client_id, sum(n) AS total, ceil(0.2::DOUBLE * sum(n)) AS tests, count(*) AS classes, min(n) AS least
  FROM {name}_n GROUP BY client_id"""),
        (f"{name}_q", f"""SELECT client_id, label, floor(n * tests / total) AS whole, tests,
  round(n * tests / total - floor(n * tests / total), 9) AS remainder,
  least >= 2 AND tests >= classes AND total - tests >= classes AS able FROM {name}_n JOIN {name}_t USING (client_id)"""),
        (f"{name}_k", f"""SELECT client_id, label, able, whole + CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY remainder DESC, label)
  <= tests - sum(whole) OVER (PARTITION BY client_id) THEN 1 ELSE 0 END AS quota FROM {name}_q"""),
        (name, f"""SELECT s.*, CASE WHEN NOT able THEN NULL WHEN row_number() OVER (PARTITION BY client_id, label
  ORDER BY {digest(purpose, 'event_id')}, event_id) <= quota THEN 'test' ELSE 'train' END AS split
  FROM {source} s JOIN {name}_k USING (client_id, label)"""),
    )


def undersampled(source: str, ratio: float, name: str = "balanced") -> tuple[str, str]:
    return (name, f"""SELECT * EXCLUDE (place, positives) FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id, label ORDER BY {digest('undersample', 'event_id')}, event_id) AS place,
    sum(label) OVER (PARTITION BY client_id) AS positives FROM {source})
  WHERE label = 1 OR place <= floor(positives * {ratio}::DOUBLE)""")


SCORED = ("scored", """SELECT *, (value - 50) / 50 AS decision, value / (value + 50) AS proba,
  CASE WHEN (value - 50) / 50 > 0 THEN 1 ELSE 0 END AS pred FROM part""")
SCORED_ALL = ("scored", SCORED[1].replace("FROM part", "FROM obs"))
EVENTS = with_(OBS)
PARTED = with_(OBS, part())
SCORED_PARTS = with_(OBS, part(), SCORED)


# --- sources, sinks and state ---------------------------------------------------------------

SQL["source_rows"] = EVENTS + "SELECT label, count(*) AS rows FROM obs GROUP BY label"
SQL["feature_projection"] = EVENTS + f"SELECT event_id, 3 AS features, {r6('value + hour + dow')} AS total FROM obs"
SQL["assemble_float32"] = with_(ORDERS) + "SELECT order_id, price::FLOAT::DOUBLE AS x0, month::FLOAT::DOUBLE AS x1 FROM obs_orders"
SQL["complete_observations"] = """SELECT count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(value > 10, false) OR event_type IS NULL) AS incomplete,
  count(*) FILTER (WHERE value > 10 AND event_type IS NOT NULL) AS kept FROM events"""
SQL["io_csv_roundtrip"] = EVENTS + "SELECT event_id, value, hour, dow, label FROM obs"
SQL["csv_preparation"] = EVENTS + f"""SELECT event_id, label, CASE WHEN row_number() OVER (ORDER BY {digest('split', 'event_id')}, event_id)
  <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM obs"""
ORDERED_SPLIT = (
    "ordered",
    f"""SELECT event_id, client_id, label, CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY {digest('partition', 'event_id')}, event_id)
  <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY client_id)) THEN 'train' ELSE 'test' END AS split FROM part""",
)
SQL["prepared_cache"] = with_(OBS, part(), ORDERED_SPLIT) + """SELECT client_id, split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives
FROM ordered GROUP BY client_id, split"""


def scaler_rows(columns: list[str], source: str, where: str = "") -> str:
    parts = [
        f"SELECT '{c}' AS feature, {r6(f'avg({c})', 8)} AS mean, {r6(f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END', 8)} AS scale, count({c}) AS n FROM {source} {where}"
        for c in columns
    ]
    return "\nUNION ALL ".join(parts)


SQL["scaler_state"] = EVENTS + scaler_rows(FEATURES, "obs")

CENTROIDS = (
    "centroids",
    """SELECT client_id, n_examples, CASE WHEN share < 0.2::DOUBLE THEN 'failed' ELSE 'ok' END AS status, w0, w1,
  round(-(w0 * (v1 + v0) / 2 + w1 * (h1 + h0) / 2), 9) AS intercept FROM (
  SELECT client_id, count(*) AS n_examples, avg(label) AS share,
    avg(value) FILTER (WHERE label = 1) AS v1, avg(value) FILTER (WHERE label = 0) AS v0,
    avg(hour) FILTER (WHERE label = 1) AS h1, avg(hour) FILTER (WHERE label = 0) AS h0,
    round(v1 - v0, 9) AS w0, round(h1 - h0, 9) AS w1 FROM part GROUP BY client_id)""",
)
MODELS = with_(OBS, part(), CENTROIDS)
SQL["latest_model"] = MODELS + "SELECT 3 AS round, client_id, 3 * n_examples AS n_examples, status, w0, w1, intercept FROM centroids"


# --- forests --------------------------------------------------------------------------------


def _path(path) -> str:
    return " AND ".join(f"{FEATURES[f]} {'<=' if left else '>'} t{f}" for f, left in path) or "true"


def _forest_tables() -> tuple[tuple[str, str], ...]:
    selects = []
    for t, node, feature, left, right, path in TREES:
        threshold = "NULL::DOUBLE" if feature is None else f"any_value(t{feature})"
        selects.append(
            f"SELECT client_id, {t} AS tree_id, {node} AS node_id, {-1 if feature is None else feature} AS feature, {threshold} AS threshold, "
            f"{left} AS lft, {right} AS rgt, count(*) FILTER (WHERE ({_path(path)}) AND label = 0) AS c0, "
            f"count(*) FILTER (WHERE ({_path(path)}) AND label = 1) AS c1 FROM cut GROUP BY client_id"
        )
    means = ", ".join(f"round(avg({c}), 6) AS t{i}" for i, c in enumerate(FEATURES))
    return (
        ("means", f"SELECT client_id, {means} FROM part GROUP BY client_id"),
        ("cut", "SELECT part.*, t0, t1, t2 FROM part JOIN means USING (client_id)"),
        ("nodes", "\nUNION ALL ".join(selects)),
        ("merged", """SELECT dense_rank() OVER (ORDER BY client_id, tree_id) - 1 AS tree_id, node_id, feature, threshold, lft, rgt, c0, c1,
  c0 + c1 AS n FROM nodes"""),
    )


FOREST = (OBS, part(), *_forest_tables())
# Every event walks every tree, one level per step.
WALK = (
    ("walk", """SELECT event_id, tree_id, 0 AS node_id, value, hour, dow FROM part CROSS JOIN (SELECT DISTINCT tree_id FROM used)
  UNION ALL
  SELECT w.event_id, w.tree_id, CASE WHEN CASE m.feature WHEN 0 THEN w.value WHEN 1 THEN w.hour ELSE w.dow END <= m.threshold THEN m.lft ELSE m.rgt END,
    w.value, w.hour, w.dow FROM walk w JOIN used m ON w.tree_id = m.tree_id AND w.node_id = m.node_id WHERE m.lft >= 0"""),
    ("leaf", """SELECT w.event_id, w.tree_id, CASE WHEN m.n > 0 THEN m.c1::DOUBLE / m.n ELSE 0 END AS share
  FROM walk w JOIN used m ON w.tree_id = m.tree_id AND w.node_id = m.node_id WHERE m.lft < 0"""),
)
USED = ("used", "SELECT * FROM merged")
PROBA = ("proba", "SELECT event_id, avg(share) AS proba FROM leaf GROUP BY event_id")
SCORES = ("scores", """SELECT tree_id, count(*) FILTER (WHERE (share > 0.5)::INT = label) AS hits, count(*) AS rows,
  count(*) FILTER (WHERE (share > 0.5)::INT = label)::DOUBLE / count(*) AS score FROM leaf JOIN part USING (event_id) GROUP BY tree_id""")


def pruned(keep: str) -> str:
    return f"""SELECT CAST(new_id AS INTEGER) AS tree_id, node_id, feature, threshold, n FROM merged JOIN (
  SELECT tree_id, row_number() OVER (ORDER BY score, tree_id) - 1 AS new_id FROM (
    SELECT tree_id, score, row_number() OVER (ORDER BY score DESC, tree_id DESC) AS place FROM scores) WHERE place <= {keep}) USING (tree_id)"""


SQL["forest_checkpoint"] = with_(*FOREST) + """SELECT 4 AS round, client_id, count(*) AS nodes, CAST(sum(c0 + c1) AS BIGINT) AS rows
FROM nodes GROUP BY client_id"""
SQL["merge_forests"] = with_(*FOREST) + """SELECT 1 AS round, CAST(tree_id AS INTEGER) AS tree_id, node_id, feature, threshold,
lft AS "left", rgt AS "right", n FROM merged"""
SQL["tree_scores"] = with_(*FOREST, USED, *WALK, SCORES) + f"SELECT CAST(tree_id AS INTEGER) AS tree_id, hits, rows, {r6('score')} AS score FROM scores"
SQL["prune_forest"] = with_(*FOREST, USED, *WALK, SCORES) + pruned("4")
SQL["merge_and_prune"] = with_(*FOREST, USED, *WALK, SCORES) + pruned("greatest(10, (SELECT count(*) // 2 FROM scores))")
SQL["target_trees"] = with_(*FOREST) + """SELECT count(*) AS total_trees, CAST(greatest(10, count(*) // 2) AS INTEGER) AS target
FROM (SELECT DISTINCT client_id, tree_id FROM nodes)"""
FOREST_PROBA = f"SELECT event_id, {r6('proba')} AS proba, CASE WHEN proba > 0.5 THEN 1 ELSE 0 END AS pred FROM proba"
SQL["forest_proba"] = with_(*FOREST, USED, *WALK, PROBA) + FOREST_PROBA
BEST_FOUR = ("proba", """SELECT event_id, avg(share) AS proba FROM leaf WHERE tree_id IN (
  SELECT tree_id FROM scores ORDER BY score DESC, tree_id DESC LIMIT 4) GROUP BY event_id""")
SQL["forest_proba_small"] = with_(*FOREST, USED, *WALK, SCORES, BEST_FOUR) + FOREST_PROBA


def gini(zero: str, one: str) -> str:
    n = f"({zero} + {one})::DOUBLE"
    return f"(CASE WHEN {zero} + {one} > 0 THEN 1 - ({zero} / {n}) * ({zero} / {n}) - ({one} / {n}) * ({one} / {n}) ELSE 0 END)"


SQL["feature_importance"] = with_(
    *FOREST,
    ("gains", f"""SELECT p.client_id, p.tree_id, p.feature, sum((p.c0 + p.c1) * (
    {gini('p.c0', 'p.c1')} - (l.c0 + l.c1)::DOUBLE / (p.c0 + p.c1) * {gini('l.c0', 'l.c1')} - (r.c0 + r.c1)::DOUBLE / (p.c0 + p.c1) * {gini('r.c0', 'r.c1')})) AS g
  FROM nodes p JOIN nodes l ON l.client_id = p.client_id AND l.tree_id = p.tree_id AND l.node_id = p.lft
  JOIN nodes r ON r.client_id = p.client_id AND r.tree_id = p.tree_id AND r.node_id = p.rgt WHERE p.lft >= 0 GROUP BY ALL"""),
    ("shares", "SELECT feature, g / sum(g) OVER (PARTITION BY client_id, tree_id) AS g FROM gains"),
) + f"""SELECT f.name AS feature, {r6('coalesce(s.g, 0) / (SELECT sum(g) FROM shares)')} AS importance
FROM (VALUES (0, 'value'), (1, 'hour'), (2, 'dow'), (3, 'unused')) f(id, name)
LEFT JOIN (SELECT feature, sum(g) AS g FROM shares GROUP BY feature) s ON s.feature = f.id"""


# --- metrics --------------------------------------------------------------------------------

CLIPPED = "least(greatest(proba, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"


def log_loss_of(proba: str = "proba") -> str:
    p = CLIPPED.replace("proba", proba)
    return f"-(CASE WHEN label = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"


HINGE = "greatest(0, 1 - label * decision)"


def metric_tables(source: str, by: str, loss: str, name: str = "m") -> tuple[tuple[str, str], ...]:
    """Counts, then the averaged metrics; weighted by class support where one class exceeds 0.7."""
    return (
        (f"{name}_c", f"""SELECT {by}, count(*) FILTER (WHERE label = 0 AND pred = 0)::DOUBLE AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1)::DOUBLE AS fp,
  count(*) FILTER (WHERE label = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1)::DOUBLE AS tp,
  count(*) AS n_examples, CASE WHEN count({loss}) = count(*) THEN avg({loss}) END AS mean_loss FROM {source} GROUP BY {by}"""),
        (f"{name}_r", f"""SELECT *, (tn + tp) / n_examples AS accuracy, greatest(tn + fp, tp + fn) / n_examples > 0.7::DOUBLE AS skew,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
  CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0 END AS f0,
  CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END AS f1 FROM {name}_c"""),
        (name, f"""SELECT {by}, n_examples, coalesce(mean_loss, 1 - accuracy) AS loss, accuracy,
  CASE WHEN skew THEN ((tn + fp) * p0 + (tp + fn) * p1) / n_examples ELSE p1 END AS precision,
  CASE WHEN skew THEN ((tn + fp) * r0 + (tp + fn) * r1) / n_examples ELSE r1 END AS recall,
  CASE WHEN skew THEN ((tn + fp) * f0 + (tp + fn) * f1) / n_examples ELSE f1 END AS f1_score,
  CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END AS false_positive_rate,
  CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS false_negative_rate FROM {name}_r"""),
    )


def rounded(names, prefix: str = "", source: str = "") -> str:
    return ", ".join(f"{r6(source + n)} AS {prefix}{n}" for n in names)


BY_CLIENT = (OBS, part(), SCORED, *metric_tables("scored", "client_id", log_loss_of()))
SQL["prediction_distribution"] = SCORED_PARTS + """SELECT client_id, count(*) FILTER (WHERE label = 0) AS actual_negative,
count(*) FILTER (WHERE label = 1) AS actual_positive, count(*) FILTER (WHERE pred = 0) AS predicted_negative,
count(*) FILTER (WHERE pred = 1) AS predicted_positive FROM scored GROUP BY client_id"""
SQL["confusion"] = SCORED_PARTS + """SELECT client_id, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM scored GROUP BY client_id"""
SQL["accuracy"] = SCORED_PARTS + f"SELECT client_id, {r6('avg((label = pred)::INT)')} AS accuracy FROM scored GROUP BY client_id"
SQL["weighted_metrics"] = with_(*BY_CLIENT) + f"SELECT client_id, {rounded(('precision', 'recall', 'f1_score'))} FROM m"
SQL["error_rates"] = with_(*BY_CLIENT) + f"SELECT client_id, {rounded(('false_positive_rate', 'false_negative_rate'))} FROM m"
SQL["binary_metrics"] = with_(
    ORDERS,
    ("scored", """SELECT *, CASE WHEN price > 250000 THEN 1 ELSE 0 END AS pred FROM obs_orders"""),
    ("c", """SELECT month, sum(pred * label)::DOUBLE AS tp, sum(pred)::DOUBLE AS said, sum(label)::DOUBLE AS have FROM scored GROUP BY month"""),
) + f"""SELECT month, {r6('CASE WHEN said > 0 THEN tp / said ELSE 0 END')} AS precision, {r6('CASE WHEN have > 0 THEN tp / have ELSE 0 END')} AS recall,
{r6('CASE WHEN said + have > 0 THEN 2 * tp / (said + have) ELSE 0 END')} AS f1_score FROM c"""
SQL["hinge_loss"] = SCORED_PARTS + f"""SELECT client_id, {r6(f'avg({HINGE})')} AS loss,
{r6('avg(greatest(0, 1 - (2 * label - 1) * decision))')} AS signed_loss FROM scored GROUP BY client_id"""
SQL["log_loss"] = SCORED_PARTS + f"SELECT client_id, {r6(f'avg({log_loss_of()})')} AS loss FROM scored GROUP BY client_id"
SQL["fallback_metrics"] = with_(
    OBS, part(), SCORED,
    ("gaps", "SELECT label, pred, CASE WHEN value > 0.5::DOUBLE THEN proba END AS proba, CAST(floor(value / 50) AS INTEGER) AS grp FROM scored"),
    ("g", f"SELECT grp, count(*) AS n_examples, count(proba) AS known, avg({log_loss_of()}) AS mean_loss, avg((label = pred)::INT) AS acc FROM gaps GROUP BY grp"),
) + f"SELECT grp, n_examples, {r6('CASE WHEN known = n_examples THEN mean_loss ELSE 1 - acc END')} AS loss FROM g"

CLIENT_METRICS = (
    OBS, part(), ("scored", SCORED[1].replace("SELECT *", "SELECT *, CAST(hour AS INTEGER) + 1 AS round")),
    *metric_tables("scored", "round, client_id", log_loss_of()),
)


def averaged(names) -> str:
    inner = ", ".join(f"{r6(f'sum(n_examples * {n}) / sum(n_examples)')} AS {n}" for n in names)
    return with_(*CLIENT_METRICS) + f"SELECT round, {inner} FROM m GROUP BY round"


SQL["aggregate_metrics"] = averaged(METRICS)
SQL["aggregate_accuracy"] = averaged(("accuracy",))
SQL["aggregate_loss"] = averaged(("loss",))


# --- partitions, splits, sampling -----------------------------------------------------------

SQL["iid_partition"] = PARTED + "SELECT event_id, client_id FROM part"
SQL["random_split"] = with_(ORDERS) + f"""SELECT order_id, CASE WHEN row_number() OVER (ORDER BY {digest('split', 'order_id')}, order_id)
  <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM obs_orders"""
SQL["stratified_split"] = with_(OBS, part(), *stratified("part")) + "SELECT event_id, client_id, label, split FROM strat"
SQL["ordered_split"] = with_(OBS, part(), ORDERED_SPLIT) + "SELECT event_id, client_id, split FROM ordered"
SQL["central_head_test"] = PARTED + f"""SELECT event_id, client_id FROM (
  SELECT *, row_number() OVER (ORDER BY {digest('partition', 'event_id')}, event_id) AS place, count(*) OVER () AS n FROM part WHERE client_id = 0)
WHERE place <= floor(0.2::DOUBLE * n)"""
SQL["central_union_test"] = with_(OBS, part(25), *stratified("part")) + "SELECT event_id, client_id, label FROM strat WHERE split = 'test' AND client_id IN (0, 1, 2)"
SQL["undersample"] = with_(OBS, part(), undersampled("part", 1.0)) + "SELECT event_id, client_id, label FROM balanced"
SQL["oversample"] = with_(
    OBS, part(),
    ("pos", f"""SELECT event_id, client_id, count(*) OVER (PARTITION BY client_id) AS positives,
  row_number() OVER (PARTITION BY client_id ORDER BY {digest('oversample', 'event_id')}, event_id) AS place FROM part WHERE label = 1"""),
    ("draws", """SELECT client_id, positives, unnest(range(CAST(floor(positives * 1.5::DOUBLE) AS BIGINT))) AS draw
  FROM (SELECT DISTINCT client_id, positives FROM pos)"""),
    ("picked", f"""SELECT client_id, draw, 1 + CAST('0x' || substr({digest('draw', 'client_id', 'draw')}, 1, 8) AS BIGINT) % positives AS place FROM draws"""),
) + """SELECT event_id, client_id, 1 AS label, CAST(row_number() OVER (PARTITION BY client_id, event_id ORDER BY draw) AS INTEGER) AS copy
FROM picked JOIN pos USING (client_id, place)
UNION ALL SELECT event_id, client_id, label, 0 AS copy FROM part WHERE label = 0"""
SQL["balance_none"] = PARTED + "SELECT client_id, label, count(*) AS rows FROM part GROUP BY client_id, label"
SQL["hash_order"] = EVENTS + f"SELECT event_id, {digest('shuffle', 'event_id')} AS shuffle_key FROM obs"


def sampled(purpose: str, size: str, clients: str, rounds: int) -> str:
    return f"""SELECT round, client_id FROM (SELECT round, client_id, row_number() OVER (PARTITION BY round
    ORDER BY {digest(purpose, 'round', 'client_id')}, client_id) AS place
  FROM (SELECT unnest(generate_series(1, {rounds}))::INTEGER AS round), (SELECT DISTINCT client_id FROM {clients})) WHERE place <= {size}"""


SQL["sample_clients"] = with_(OBS, part(25)) + sampled("fit", "15", "part", 10)


# --- profiles and scaling -------------------------------------------------------------------

BALANCE = f"""SELECT client_id, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1,
{r6('avg(1 - label)')} AS share0, {r6('avg(label)')} AS share1, greatest(avg(label), avg(1 - label)) > 0.7::DOUBLE AS is_imbalanced,
count(*) AS total_samples MORE FROM part GROUP BY client_id"""
SQL["class_balance"] = PARTED + BALANCE.replace("MORE", "")
SQL["dataset_profile"] = PARTED + BALANCE.replace("MORE", ", 3 AS num_features")
SQL["partition_shape"] = PARTED + "SELECT client_id, count(*) AS rows, 3 AS features FROM part GROUP BY client_id"
SQL["positive_ratio"] = with_(OBS, part(), undersampled("part", 2.0)) + f"SELECT client_id, {r6('avg(label)')} AS positive_ratio FROM balanced GROUP BY client_id"
SQL["weight_stats"] = MODELS + f"""SELECT client_id, {r6('(w0 + w1) / 2')} AS weight_mean, {r6('abs(w0 - w1) / 2')} AS weight_std FROM centroids"""
LINES = ("lines", "SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem")
SQL["scaler_fit"] = with_(LINES) + scaler_rows(["quantity", "price", "discount", "tax"], "lines")


def zscores(columns: list[str], source: str, fitted_on: str) -> str:
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in columns
    )
    return f"SELECT * REPLACE ({', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in columns)}) FROM {source}, (SELECT {stats} FROM {fitted_on})"


SQL["scaler_apply"] = with_(OBS, ("z", zscores(FEATURES, "obs", "obs"))) + f"SELECT event_id, {rounded(FEATURES)} FROM z"
SQL["scaler_first_partition"] = PARTED + scaler_rows(FEATURES, "part", "WHERE client_id = 0")
LONG_VECTORS = ("long_v", "SELECT vec_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings")
SQL["scaler_wide"] = with_(LONG_VECTORS) + f"""SELECT 'x' || lpad(i::VARCHAR, 2, '0') AS feature, {r6('avg(v)', 8)} AS mean,
{r6('CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END', 8)} AS scale, count(v) AS n FROM long_v GROUP BY i"""


# --- local training -------------------------------------------------------------------------


def draw(position: str) -> str:
    """A starting weight: Box-Muller on two uniforms of the digest, scaled by 0.01."""
    h = digest("init", position)
    u = [f"((CAST('0x' || substr({h}, {at}, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE)" for at in (1, 9)]
    return f"(0.01::DOUBLE * sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]}))"


def slope(loss: str, f: str, y: str = "label") -> str:
    z = f"(2 * {y} - 1)"
    if loss == "hinge":
        return f"(CASE WHEN {z} * ({f}) < 1 THEN -{z} ELSE 0 END)"
    if loss == "modified_huber":
        return f"(CASE WHEN {z} * ({f}) >= 1 THEN 0 WHEN {z} * ({f}) > -1 THEN -2 * {z} * (1 - {z} * ({f})) ELSE -4 * {z} END)"
    return f"(1 / (1 + exp(-({f}))) - {y})"


# Strength and curvature by loss, shares of l1 and l2 by penalty.
STRENGTH = {"log_loss": "1.0::DOUBLE / n", "hinge": "0.001::DOUBLE", "modified_huber": "0.0001::DOUBLE"}
CURVATURE = {"log_loss": "0.25::DOUBLE", "hinge": "1", "modified_huber": "2"}
SHARES = {None: (0.0, 0.0), "l1": (1.0, 0.0), "l2": (0.0, 1.0), "elasticnet": (0.15, 0.85)}


def stepped(w: str, gradient: str, step: str, strength: str, penalty: str | None) -> str:
    l1, l2 = SHARES[penalty]
    moved = f"({w} - {step} * ({gradient}))"
    if l1:
        moved = f"(sign({moved}) * greatest(abs({moved}) - {step} * {strength} * {l1}::DOUBLE, 0))"
    return f"({moved} / (1 + {step} * {strength} * {l2}::DOUBLE))" if l2 else moved


def trained(rows: str, start: str, loss: str, penalty: str | None, epochs: int, name: str) -> tuple[tuple[str, str], ...]:
    """Full-batch epochs of two features (x0, x1), every client from its row in `start`."""
    weight = ("n / (2.0 * n0)", "n / (2.0 * n1)") if loss == "modified_huber" else ("1", "1")
    size = "(x0 * x0 + x1 * x1 + 1)"
    tables = [
        (f"{name}_s", f"""SELECT *, {weight[0]} AS c0, {weight[1]} AS c1, {STRENGTH[loss]} AS lam,
  n / ({CURVATURE[loss]} * (({weight[0]}) * s0 + ({weight[1]}) * s1)) AS eta FROM (
  SELECT client_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 0)::DOUBLE AS n0, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1,
    sum(CASE WHEN label = 0 THEN {size} ELSE 0 END) AS s0, sum(CASE WHEN label = 1 THEN {size} ELSE 0 END) AS s1 FROM {rows} GROUP BY client_id)"""),
        (f"{name}_0", f"SELECT s.*, w.w0, w.w1, w.b FROM {name}_s s JOIN {start} w USING (client_id)"),
    ]
    for e in range(1, epochs + 1):
        f = "x0 * w0 + x1 * w1 + b"
        tables.append((f"{name}_g{e}", f"""SELECT client_id, sum(r * x0) AS g0, sum(r * x1) AS g1, sum(r) AS gb FROM (
  SELECT client_id, x0, x1, (CASE WHEN label = 1 THEN c1 ELSE c0 END) * {slope(loss, f)} AS r FROM {rows} JOIN {name}_{e - 1} USING (client_id)) GROUP BY client_id"""))
        tables.append((f"{name}_{e}", f"""SELECT * EXCLUDE (w0, w1, b, g0, g1, gb), {stepped('w0', 'g0 / n', 'eta', 'lam', penalty)} AS w0,
  {stepped('w1', 'g1 / n', 'eta', 'lam', penalty)} AS w1, b - eta * gb / n AS b FROM {name}_{e - 1} JOIN {name}_g{e} USING (client_id)"""))
    return tuple(tables)


TWO_FEATURES = ("two", "SELECT client_id, label, event_id, value / 100 AS x0, hour / 24 AS x1 FROM part")
START = ("start", f"SELECT client_id, {draw('0')} AS w0, {draw('1')} AS w1, {draw('2')} AS b FROM (SELECT DISTINCT client_id FROM part)")


def epochs_sql(loss: str, penalty: str | None) -> str:
    return with_(OBS, part(), TWO_FEATURES, START, *trained("two", "start", loss, penalty, 2, "fit")) + f"""SELECT client_id, n::BIGINT AS n_examples,
'ok' AS status, {r6('w0')} AS w0, {r6('w1')} AS w1, {r6('b')} AS intercept FROM fit_2"""


SQL["logistic_epoch"] = epochs_sql("log_loss", "l2")
SQL["hinge_epoch"] = epochs_sql("hinge", "l2")
SQL["huber_epoch"] = epochs_sql("modified_huber", "l2")
SQL["elastic_epoch"] = epochs_sql("log_loss", "elasticnet")
SQL["whole_client_fit"] = SQL["logistic_epoch"]
SQL["block_fit"] = SQL["logistic_epoch"]
# One step per row: every client reads its next row in hash order, decays its weights, then moves.
SQL["sequential_fit"] = with_(
    OBS, part(), TWO_FEATURES, START,
    ("queue", f"""SELECT client_id, label, x0, x1, count(*) OVER (PARTITION BY client_id) AS n,
  row_number() OVER (PARTITION BY client_id ORDER BY {digest('sgd', 'event_id')}, event_id) AS place FROM two"""),
    ("queued", "SELECT * FROM queue UNION ALL SELECT * REPLACE (place + n AS place) FROM queue"),
    ("sgd", f"""SELECT client_id, 0::BIGINT AS done, w0, w1, b FROM start
  UNION ALL
  SELECT client_id, place, keep * w0 + push * x0, keep * w1 + push * x1, b + push FROM (
    SELECT s.client_id, q.place, s.w0, s.w1, s.b, q.x0, q.x1, 1 - 0.001::DOUBLE * eta AS keep,
      CASE WHEN (2 * label - 1) * (s.w0 * q.x0 + s.w1 * q.x1 + s.b) <= 1 THEN eta * (2 * label - 1) ELSE 0 END AS push
    FROM (SELECT *, 1 / (0.001::DOUBLE * (1 / (sqrt(1 / sqrt(0.001::DOUBLE)) * 0.001::DOUBLE) + done)) AS eta FROM sgd) s
    JOIN queued q ON q.client_id = s.client_id AND q.place = s.done + 1)"""),
) + f"""SELECT client_id, n AS n_examples, 'ok' AS status, {r6('w0')} AS w0, {r6('w1')} AS w1, {r6('b')} AS intercept
FROM sgd JOIN (SELECT client_id, count(*) AS n FROM two GROUP BY client_id) USING (client_id) WHERE done = 2 * n"""
SQL["sequential_fit_chunked"] = SQL["sequential_fit"]
SQL["initial_model"] = with_(LONG_VECTORS) + f"""SELECT vec_id, {r6(f"sum(v * {draw('i')}) + any_value({draw('64')})")} AS decision FROM long_v GROUP BY vec_id"""
# From zero weights every probability is 1/2, so one epoch has a closed form.
SQL["wide_epoch"] = with_(
    LONG_VECTORS,
    ("size", "SELECT count(*) AS n, sum(s) AS trace FROM (SELECT vec_id, sum(v * v) + 1 AS s FROM long_v GROUP BY vec_id)"),
    ("g", "SELECT i, sum((0.5::DOUBLE - label) * v) AS g FROM long_v GROUP BY i"),
) + f"""SELECT i::INTEGER AS dim, {r6("-(n / (0.25::DOUBLE * trace)) * g / n / (1 + (n / (0.25::DOUBLE * trace)) / n)")} AS weight FROM g, size"""
STEPS = {"none": None, "l1": "l1", "l2": "l2", "elastic": "elasticnet"}
SQL["penalty_step"] = with_(
    OBS, part(), CENTROIDS, ("w", "SELECT client_id, 0 AS dim, w0 AS w FROM centroids UNION ALL SELECT client_id, 1, w1 FROM centroids")
) + "SELECT client_id, dim, " + ", ".join(f"{r6(stepped('w', 'w * 0.25::DOUBLE', '0.1::DOUBLE', '0.5::DOUBLE', p))} AS \"{n}\"" for n, p in STEPS.items()) + " FROM w"
HOURS = with_(OBS, ("h", "SELECT CAST(hour AS INTEGER) + 1 AS round, count(*) AS rows FROM obs GROUP BY 1"))
SQL["lr_schedule"] = HOURS + f"SELECT round, rows, {r6('0.01::DOUBLE / (1 + 0.1::DOUBLE * round)')} AS eta FROM h"
SQL["epoch_schedule"] = HOURS + "SELECT round, rows, CASE WHEN round > 5 THEN 30 ELSE 15 END AS sgd_epochs, 20 AS logistic_epochs FROM h"
SQL["tree_schedule"] = HOURS + "SELECT round, rows, CASE WHEN round >= 4 THEN 20 WHEN round >= 2 THEN 15 ELSE 10 END AS trees FROM h"


# --- aggregation, prediction and evaluation -------------------------------------------------


def mean_model(where: str = "") -> str:
    return f"""SELECT CAST(sum(n_examples) AS BIGINT) AS n_examples, sum(n_examples * w0) / sum(n_examples) AS w0,
  sum(n_examples * w1) / sum(n_examples) AS w1, sum(n_examples * intercept) / sum(n_examples) AS intercept FROM centroids {where}"""


FLAT = f"n_examples, {r6('w0')} AS w0, {r6('w1')} AS w1, {r6('intercept')} AS intercept"
SQL["fedavg"] = MODELS + f"SELECT 1 AS round, {FLAT} FROM ({mean_model()})"
OK = "WHERE status = 'ok'"
SQL["fedavg_failures"] = MODELS + f"""SELECT 1 AS round, {FLAT} FROM ({mean_model(OK)}) WHERE n_examples IS NOT NULL
UNION ALL SELECT 1 AS round, {FLAT} FROM ({mean_model()}) WHERE NOT EXISTS (SELECT 1 FROM centroids {OK})
UNION ALL SELECT 2 AS round, {FLAT} FROM ({mean_model()})"""
OWN = ("own", "SELECT part.*, value * w0 + hour * w1 + intercept AS decision FROM part JOIN centroids USING (client_id)")
SQL["decision_value"] = with_(OBS, part(), CENTROIDS, OWN) + f"SELECT event_id, {r6('decision', 4)} AS decision FROM own"
SQL["predict_linear"] = with_(OBS, part(), CENTROIDS, OWN) + "SELECT event_id, client_id, CASE WHEN decision > 0 THEN 1 ELSE 0 END AS pred FROM own"
SQL["predict_proba"] = with_(OBS, part(), CENTROIDS, OWN) + f"""SELECT event_id, {r6('1 / (1 + exp(-decision))')} AS logistic,
{r6('(least(greatest(decision, -1), 1) + 1) / 2', 4)} AS huber FROM own"""
GLOBALS = ("globals", f"""SELECT 1 AS round, {FLAT} FROM ({mean_model()}) UNION ALL SELECT 2 AS round, {FLAT} FROM ({mean_model(OK)}) WHERE n_examples IS NOT NULL""")


def judged(rows: str, models: str = "globals", x0: str = "value", x1: str = "hour", bias: str = "intercept") -> tuple[str, str]:
    return ("judged", f"""SELECT round, client_id, label, decision, 1 / (1 + exp(-decision)) AS proba, CASE WHEN decision > 0 THEN 1 ELSE 0 END AS pred
  FROM (SELECT round, client_id, label, {bias} + {x0} * w0 + {x1} * w1 AS decision FROM {rows}, {models})""")


SQL["evaluate_clients"] = with_(OBS, part(), CENTROIDS, GLOBALS, judged("part"), *metric_tables("judged", "round, client_id", log_loss_of())) + f"""SELECT round,
client_id, n_examples, {rounded(LOG_METRICS)} FROM m"""
SQL["evaluate_central"] = with_(
    OBS, part(), CENTROIDS, GLOBALS, *stratified("part"), ("central", "SELECT * FROM strat WHERE split = 'test' AND client_id IN (0, 1, 2)"),
    judged("central"), *metric_tables("judged", "round", HINGE),
) + f"SELECT round, n_examples, {rounded(LOG_METRICS, 'central_')} FROM m"
FOREST_SCORED = ("judged", "SELECT client_id, label, proba, CASE WHEN proba > 0.5 THEN 1 ELSE 0 END AS pred FROM part JOIN proba USING (event_id)")
SQL["evaluate_forest"] = with_(*FOREST, USED, *WALK, PROBA, FOREST_SCORED, *metric_tables("judged", "client_id", log_loss_of())) + f"""SELECT client_id,
n_examples, {rounded(('loss', 'accuracy'))} FROM m"""
SQL["forest_scorecard"] = with_(
    *FOREST, USED, *WALK, PROBA, ("judged", FOREST_SCORED[1].replace("client_id, label", "0 AS scope, label")), *metric_tables("judged", "scope", log_loss_of())
) + f"SELECT {rounded(LOG_METRICS)} FROM m"


# --- forest training: every level of every tree as joins and groupings -------------------------


def fitted(source: str, trees: tuple[int, int], round_no: int, depth: int, some: int, p: str) -> tuple[tuple[str, str], ...]:
    """New trees (first and last id) for each client of `source`, as table {p}."""
    u = f"((CAST('0x' || substr({digest('bins', 'event_id')}, 1, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE)"
    value = f"CAST('0x' || substr({digest('bag', str(round_no), 'tree // 8', 'event_id')}, 1 + 4 * (tree % 8), 4) AS BIGINT)"
    weight = " + ".join(f"(v >= {b})::INT" for b in poisson_bounds())
    ranks = f"list_transform(range(1, {BINS}), lambda j: (j * m + {BINS - 1}) // {BINS})"
    tables = [
        (f"{p}_long", "\nUNION ALL ".join(f"SELECT client_id, event_id, {i} AS f, {c} AS v FROM {source}" for i, c in enumerate(FEATURES))),
        (f"{p}_some", f"""SELECT client_id, event_id FROM (SELECT client_id, event_id, count(*) OVER (PARTITION BY client_id) AS n FROM {source})
  WHERE {u} * n <= {SAMPLE_ROWS}"""),
        (f"{p}_cut", f"""SELECT client_id, f, v, row_number() OVER (PARTITION BY client_id, f ORDER BY v) - 1 AS bin FROM (SELECT DISTINCT client_id, f, v FROM (
  SELECT client_id, f, v, row_number() OVER (PARTITION BY client_id, f ORDER BY v) AS r, count(*) OVER (PARTITION BY client_id, f) AS m
  FROM {p}_long JOIN {p}_some USING (client_id, event_id)) WHERE list_contains({ranks}, r))"""),
        (f"{p}_binned", f"""SELECT l.client_id, l.event_id, l.f, count(c.v) AS bin FROM {p}_long l
  LEFT JOIN {p}_cut c ON l.client_id = c.client_id AND l.f = c.f AND c.v < l.v GROUP BY ALL"""),
        (f"{p}_at0", f"""SELECT * FROM (SELECT client_id, event_id, label, tree, {weight} AS w, 0 AS node FROM (
  SELECT client_id, event_id, label, tree, {value} AS v FROM {source}, (SELECT unnest(range({trees[0]}, {trees[1] + 1})) AS tree))) WHERE w > 0"""),
    ]
    n, left = "(t0 + t1)", "(l0 + l1)"

    def impurity(zero: str, one: str) -> str:
        total = f"({zero} + {one})"
        return f"(1.0::DOUBLE - ({zero} / {total}) * ({zero} / {total}) - ({one} / {total}) * ({one} / {total}))"

    gain = f"{impurity('t0', 't1')} - {left} / {n} * {impurity('l0', 'l1')} - ({n} - {left}) / {n} * {impurity('(t0 - l0)', '(t1 - l1)')}"
    for d in range(depth):
        tables += [
            (f"{p}_seen{d}", f"""SELECT client_id, tree, node, f FROM (SELECT client_id, tree, node, f, row_number() OVER (PARTITION BY client_id, tree, node
  ORDER BY {digest('features', str(round_no), 'client_id', 'tree', 'node', 'f')}) AS place
  FROM (SELECT DISTINCT client_id, tree, node FROM {p}_at{d}), (SELECT unnest(range({len(FEATURES)})) AS f)) WHERE place <= {some}"""),
            (f"{p}_cell{d}", f"""SELECT client_id, tree, node, f, bin, coalesce(sum(w) FILTER (WHERE label = 0), 0)::DOUBLE AS n0,
  coalesce(sum(w) FILTER (WHERE label = 1), 0)::DOUBLE AS n1
  FROM {p}_at{d} JOIN {p}_binned USING (client_id, event_id) JOIN {p}_seen{d} USING (client_id, tree, node, f) GROUP BY ALL"""),
            (f"{p}_run{d}", f"""SELECT client_id, tree, node, f, bin, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1,
  sum(n0) OVER v AS t0, sum(n1) OVER v AS t1 FROM {p}_cell{d}
  WINDOW v AS (PARTITION BY client_id, tree, node, f), w AS (PARTITION BY client_id, tree, node, f ORDER BY bin)"""),
            (f"{p}_best{d}", f"""SELECT * FROM (SELECT client_id, tree, node, f, bin, gain, row_number() OVER (PARTITION BY client_id, tree, node
  ORDER BY gain DESC, f, bin) AS place FROM (SELECT *, {gain} AS gain FROM {p}_run{d} WHERE {left} > 0 AND {left} < {n}) WHERE gain > {LEAST_GAIN}) WHERE place = 1"""),
            (f"{p}_at{d + 1}", f"""SELECT client_id, a.event_id, label, tree, w, 2 * node + 1 + (b.bin > s.bin)::INT AS node
  FROM {p}_at{d} a JOIN {p}_best{d} s USING (client_id, tree, node) JOIN {p}_binned b USING (client_id, event_id, f)"""),
        ]
    every = "\nUNION ALL ".join(f"SELECT client_id, tree, node, label, w FROM {p}_at{d}" for d in range(depth + 1))
    splits = "\nUNION ALL ".join(f"SELECT client_id, tree, node, f, bin, gain FROM {p}_best{d}" for d in range(depth))
    return (*tables, (f"{p}_sum", f"""SELECT client_id, tree, node, coalesce(sum(w) FILTER (WHERE label = 0), 0)::BIGINT AS c0,
  coalesce(sum(w) FILTER (WHERE label = 1), 0)::BIGINT AS c1 FROM ({every}) GROUP BY ALL"""), (p, f"""SELECT client_id, CAST(tree AS INTEGER) AS tree_id, CAST(node AS INTEGER) AS node_id,
  CAST(coalesce(f, -1) AS INTEGER) AS feature, v AS threshold, CAST(CASE WHEN f IS NULL THEN -1 ELSE 2 * node + 1 END AS INTEGER) AS lft,
  CAST(CASE WHEN f IS NULL THEN -1 ELSE 2 * node + 2 END AS INTEGER) AS rgt, c0, c1, coalesce(gain, -1) AS gain, c0 + c1 AS n
  FROM {p}_sum LEFT JOIN ({splits}) USING (client_id, tree, node) LEFT JOIN {p}_cut USING (client_id, f, bin)"""))


NODE_COLUMNS = f"""client_id, tree_id, node_id, feature, {r6('threshold')} AS threshold, lft AS "left", rgt AS "right", c0, c1, {r6('gain', 9)} AS gain, n"""
SQL["tree_fit"] = with_(OBS, part(), *fitted("part", (0, 2), 1, 3, 2, "fit")) + f"SELECT {NODE_COLUMNS} FROM fit"
SQL["grow_forest"] = with_(*FOREST, *fitted("part", (2, 3), 2, 3, 1, "fit"), ("grown", """SELECT client_id, tree_id, node_id, feature, threshold, lft, rgt, c0, c1, c0 + c1 AS n FROM nodes
  UNION ALL SELECT client_id, tree_id, node_id, feature, threshold, lft, rgt, c0, c1, n FROM fit""")) + f"""SELECT client_id,
  tree_id, node_id, feature, {r6('threshold')} AS threshold, lft AS "left", rgt AS "right", c0, c1, n FROM grown"""


def walked(rows: str, used: str, p: str) -> tuple[tuple[str, str], ...]:
    """Every row of `rows` down every tree of `used`: {p} has the share of class 1 in its leaf."""
    value = "CASE m.feature WHEN 0 THEN w.value WHEN 1 THEN w.hour ELSE w.dow END"
    return (
        (f"{p}_walk", f"""SELECT event_id, client_id, label, tree_id, 0 AS node_id, value, hour, dow FROM {rows} CROSS JOIN (SELECT DISTINCT tree_id FROM {used})
  UNION ALL
  SELECT w.event_id, w.client_id, w.label, w.tree_id, CASE WHEN {value} <= m.threshold THEN m.lft ELSE m.rgt END, w.value, w.hour, w.dow
  FROM {p}_walk w JOIN {used} m ON w.tree_id = m.tree_id AND w.node_id = m.node_id WHERE m.lft >= 0"""),
        (p, f"""SELECT w.event_id, w.client_id, w.label, w.tree_id, CASE WHEN m.n > 0 THEN m.c1::DOUBLE / m.n ELSE 0 END AS share
  FROM {p}_walk w JOIN {used} m ON w.tree_id = m.tree_id AND w.node_id = m.node_id WHERE m.lft < 0"""),
    )


def forest_rounds(rounds: int, clients: int, kept: int, targets: list[int], start: str | None = None) -> tuple[tuple[tuple[str, str], ...], str]:
    """The forest job round by round: tables, and the query of its metrics. `start` is a table of trees that all clients begin with."""
    tables: list[tuple[str, str]] = [
        ("dealt", f"""SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {digest('partition', 'event_id')}, event_id)
  <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY client_id)) AS trains FROM part"""),
        ("train", "SELECT * FROM dealt WHERE trains"),
        ("test", "SELECT * FROM dealt WHERE NOT trains"),
    ]
    columns, model, have, out = "tree_id, node_id, feature, threshold, lft, rgt, c0, c1, n", start, kept if start else 0, []
    for r in range(1, rounds + 1):
        trees = []
        if model:
            trees.append(f"SELECT chosen AS client_id, {columns} FROM {model}, (SELECT DISTINCT client_id AS chosen FROM train)")
        if targets[r - 1] > have:
            tables += fitted("train", (have, targets[r - 1] - 1), r, 3, 1, f"fit{r}")
            trees.append(f"SELECT client_id, {columns} FROM fit{r}")
        numbered = columns.replace("tree_id", "dense_rank() OVER (ORDER BY client_id, tree_id) - 1 AS tree_id")
        union = "\nUNION ALL ".join(trees)
        tables += [(f"all{r}", f"SELECT {numbered} FROM ({union})"), *walked("test", f"all{r}", f"leaf{r}")]
        tables += [
            (f"score{r}", f"SELECT tree_id, count(*) FILTER (WHERE (share > 0.5)::INT = label)::DOUBLE / count(*) AS score FROM leaf{r} GROUP BY tree_id"),
            (f"id{r}", f"""SELECT tree_id AS old_id, row_number() OVER (ORDER BY score, tree_id) - 1 AS new_id FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, tree_id DESC) AS place FROM score{r}) WHERE place <= {kept}"""),
            (f"model{r}", f"SELECT {columns.replace('tree_id', 'new_id AS tree_id')} FROM all{r} JOIN id{r} ON tree_id = old_id"),
            (f"proba{r}", f"SELECT event_id, client_id, label, avg(share) AS proba FROM leaf{r} JOIN id{r} ON tree_id = old_id GROUP BY ALL"),
            (f"judged{r}", f"SELECT *, CASE WHEN proba > 0.5 THEN 1 ELSE 0 END AS pred FROM proba{r}"),
            *metric_tables(f"judged{r}", "client_id", log_loss_of(), f"m{r}"),
        ]
        means = ", ".join(f"{r6(f'sum(n_examples * {m}) / sum(n_examples)')} AS {m}" for m in ("loss", "accuracy"))
        out.append(f"SELECT {r} AS round, {means} FROM m{r}")
        model, have = f"model{r}", kept
    return tuple(tables), "\nUNION ALL ".join(out)


FOREST_JOB, FOREST_METRICS = forest_rounds(5, 10, 10, [10, 15, 15, 20, 20])
SQL["federated_forest"] = with_(OBS, part(10), *FOREST_JOB) + FOREST_METRICS
U = "((CAST('0x' || substr({}, {}, 8) AS BIGINT) + 1) / 4294967296.0::DOUBLE)"


def noise(i: int) -> str:
    h = digest("noise", str(i), "event_id")
    return f"sqrt(-2 * ln({U.format(h, 1)})) * cos(2 * pi() * {U.format(h, 9)})"


NOISE = ("noise", f"""SELECT 0 AS client_id, event_id, ({U.format(digest('noise label', 'event_id'), 1)} <= 0.5)::INT AS label,
  {', '.join(f'{noise(i)} AS {c}' for i, c in enumerate(FEATURES))} FROM (SELECT unnest(range(100)) AS event_id)""")
WARM_JOB, WARM_METRICS = forest_rounds(2, 4, 6, [10, 15], "start")
SQL["federated_forest_warm"] = with_(OBS, part(4), NOISE, *fitted("noise", (0, 5), 0, 3, 1, "start"), *WARM_JOB) + WARM_METRICS


# --- reports --------------------------------------------------------------------------------

LOG = (OBS, ("scored", SCORED_ALL[1].replace("SELECT *", "SELECT *, CAST(hour AS INTEGER) + 1 AS round")), *metric_tables("scored", "round", log_loss_of()))
SQL["round_log_roundtrip"] = with_(*LOG) + f"SELECT round, {rounded(LOG_METRICS)} FROM m"
SQL["round_log_load"] = SQL["round_log_roundtrip"]
LONG = ("long_log", "\nUNION ALL ".join(f"SELECT round, '{n}' AS metric, {n} AS value FROM m" for n in LOG_METRICS))
ENDS = ("ends", """SELECT metric, arg_min(value, round) AS initial_value, arg_max(value, round) AS final_value FROM long_log GROUP BY metric""")
SQL["round_summary"] = with_(*LOG, LONG, ENDS) + f"""SELECT metric, {r6('initial_value')} AS initial_value, {r6('final_value')} AS final_value,
{r6('final_value - initial_value')} AS improvement FROM ends"""
SQL["report_files"] = with_(*LOG, LONG, ENDS) + f"SELECT metric, {r6('final_value - initial_value')} AS improvement FROM ends"
SQL["round_summary_marks"] = with_(*LOG, LONG, ENDS) + """SELECT metric, printf('%.4f', final_value - initial_value) || ' ' ||
CASE WHEN (final_value - initial_value) * (CASE WHEN metric IN ('loss', 'false_positive_rate', 'false_negative_rate') THEN -1 ELSE 1 END) > 0
THEN '✓' ELSE '✗' END AS change FROM ends"""
SERIES = {
    "learning_curves": "'accuracy', 'loss'",
    "precision_recall": "'precision', 'recall', 'f1_score'",
    "error_rates": "'false_positive_rate', 'false_negative_rate'",
    "overview": ", ".join(f"'{n}'" for n in LOG_METRICS),
}
SQL["round_series"] = with_(*LOG, LONG) + "\nUNION ALL ".join(
    f"SELECT round, metric, {r6('value')} AS value, '{chart}' AS chart FROM long_log WHERE metric IN ({names})" for chart, names in SERIES.items()
)
SQL["convergence_flags"] = with_(*LOG, ("steps", "SELECT round, loss, lag(loss) OVER (ORDER BY round) AS previous_loss FROM m")) + f"""SELECT 'events' AS run_id, round,
{r6('loss')} AS loss, {r6('previous_loss')} AS previous_loss, coalesce(abs(loss - previous_loss) <= 0.01::DOUBLE, false) AS plateau,
coalesce(loss - previous_loss > 0.01::DOUBLE, false) AS loss_increase FROM steps"""


# --- whole jobs -----------------------------------------------------------------------------


def prepared_rows(ratio: float) -> tuple[tuple[str, str], ...]:
    single = ("single", "SELECT event_id, label, value::FLOAT::DOUBLE AS x0, hour::FLOAT::DOUBLE AS x1 FROM obs")
    scaled = ("scaled", zscores(["x0", "x1"], "part", "part WHERE client_id = 0"))
    return (OBS, single, part(source="single"), scaled, undersampled("scaled", ratio), *stratified("balanced", "undersample"))


def job(loss: str, ratio: float, fit: int, evaluate: int) -> str:
    """Two rounds of two epochs, the sampled clients averaged, all clients and the centre evaluated."""
    tables = list(prepared_rows(ratio))
    tables.append(("train", "SELECT * FROM strat WHERE split = 'train'"))
    tables.append(("fits", sampled("fit", str(fit), "train", 2)))
    tables.append(("asks", sampled("evaluate", str(evaluate), "train", 2)))
    tables.append(("g0", f"SELECT {draw('0')} AS w0, {draw('1')} AS w1, {draw('2')} AS b"))
    for r in (1, 2):
        tables.append((f"start{r}", f"SELECT client_id, w0, w1, b FROM fits, g{r - 1} WHERE round = {r}"))
        tables.append((f"rows{r}", f"SELECT * FROM train WHERE client_id IN (SELECT client_id FROM start{r})"))
        tables.extend(trained(f"rows{r}", f"start{r}", loss, "l2", 2, f"fit{r}"))
        tables.append((f"g{r}", f"SELECT sum(n)::BIGINT AS n_examples, sum(n * w0) / sum(n) AS w0, sum(n * w1) / sum(n) AS w1, sum(n * b) / sum(n) AS b FROM fit{r}_2"))
    tables.append(("models", "SELECT 1 AS round, * FROM g1 UNION ALL SELECT 2 AS round, * FROM g2"))
    tables.append(("tests", "SELECT * FROM strat WHERE split = 'test'"))
    tables.append(judged("tests", "models", "x0", "x1", "b"))
    row_loss = HINGE if loss == "hinge" else log_loss_of()
    tables.extend(metric_tables("judged", "round, client_id", row_loss, "mc"))
    tables.append(("near", "SELECT * FROM judged WHERE client_id IN (0, 1, 2)"))
    tables.extend(metric_tables("near", "round", row_loss, "mz"))
    means = ", ".join(f"sum(n_examples * {n}) / sum(n_examples) AS {n}" for n in LOG_METRICS)
    tables.append(("ma", f"SELECT round, {means} FROM mc JOIN asks USING (round, client_id) GROUP BY round"))
    return with_(*tables) + f"""SELECT models.round, models.n_examples, {r6('w0')} AS w0, {r6('w1')} AS w1, {r6('b')} AS intercept,
{rounded(LOG_METRICS, '', 'ma.')}, {rounded(LOG_METRICS, 'central_', 'mz.')} FROM models JOIN ma USING (round) JOIN mz USING (round)"""


def whole_fit(rows: str, start: str, loss: str, epochs: int, tol: float, name: str, width: int = 3) -> tuple[tuple[str, str], ...]:
    """Epochs as a recursion; a client stops once no weight moves by more than `tol` of the largest. {name}: its last weights."""
    i = range(width)
    size = "(" + " + ".join(f"x{k} * x{k}" for k in i) + " + 1)"
    f = " + ".join(["b", *[f"x{k} * w{k}" for k in i]])
    new = ", ".join(f"{stepped(f'w{k}', f'g{k} / n', 'eta', 'lam', 'l2')} AS v{k}" for k in i)
    olds, news = ", ".join(f"w{k}" for k in i), ", ".join(f"v{k}" for k in i)
    moved = ", ".join(f"abs(v{k} - w{k})" for k in i)
    return (
        (f"{name}_s", f"""SELECT *, {STRENGTH[loss]} AS lam, n / ({CURVATURE[loss]} * s) AS eta FROM (
  SELECT client_id, count(*)::DOUBLE AS n, sum({size}) AS s FROM {rows} GROUP BY client_id)"""),
        (f"{name}_e", f"""SELECT client_id, 0 AS e, false AS done, {olds}, b FROM {start}
  UNION ALL
  SELECT client_id, e + 1, greatest({moved}, abs(vb - b)) <= {tol}::DOUBLE * greatest({', '.join(f'abs(v{k})' for k in i)}, abs(vb)), {news}, vb FROM (
    SELECT client_id, e, {olds}, b, {new}, b - eta * gb / n AS vb FROM (
      SELECT client_id, any_value(e) AS e, {', '.join(f'any_value(w{k}) AS w{k}' for k in i)}, any_value(b) AS b, any_value(n) AS n, any_value(eta) AS eta,
        any_value(lam) AS lam, {', '.join(f'sum(r * x{k}) AS g{k}' for k in i)}, sum(r) AS gb FROM (
        SELECT *, {slope(loss, f)} AS r FROM {rows} JOIN {name}_e USING (client_id) JOIN {name}_s USING (client_id) WHERE NOT done AND e < {epochs})
      GROUP BY client_id))"""),
        (name, f"SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY client_id) AS last FROM {name}_e) JOIN {name}_s USING (client_id) WHERE e = last"),
    )


def whole_job(loss: str, ratio: float, clients: int, fit: int, evaluate: int, epochs: list[int]) -> str:
    """A linear job as configured: three features, its own epochs in each round, and the tolerance stop."""
    columns = ["x0", "x1", "x2"]
    tables = [
        OBS, ("single", "SELECT event_id, label, value::FLOAT::DOUBLE AS x0, hour::FLOAT::DOUBLE AS x1, dow::FLOAT::DOUBLE AS x2 FROM obs"),
        part(clients, "single"), ("scaled", zscores(columns, "part", "part WHERE client_id = 0")), undersampled("scaled", ratio), *stratified("balanced", "undersample"),
        ("train", "SELECT client_id, label, x0, x1, x2 FROM strat WHERE split = 'train'"),
        ("fits", sampled("fit", str(fit), "train", len(epochs))), ("asks", sampled("evaluate", str(evaluate), "train", len(epochs))),
        ("g0", f"SELECT {draw('0')} AS w0, {draw('1')} AS w1, {draw('2')} AS w2, {draw('3')} AS b"),
    ]
    means = ", ".join(f"sum(n * {w}) / sum(n) AS {w}" for w in ("w0", "w1", "w2", "b"))
    for r, n in enumerate(epochs, 1):
        tables.append((f"start{r}", f"SELECT client_id, w0, w1, w2, b FROM fits, g{r - 1} WHERE round = {r}"))
        tables.append((f"rows{r}", f"SELECT * FROM train WHERE client_id IN (SELECT client_id FROM start{r})"))
        tables.extend(whole_fit(f"rows{r}", f"start{r}", loss, n, 1e-4, f"fit{r}"))
        tables.append((f"g{r}", f"SELECT sum(n)::BIGINT AS n_examples, {means} FROM fit{r}"))
    tables.append(("models", " UNION ALL ".join(f"SELECT {r} AS round, * FROM g{r}" for r in range(1, len(epochs) + 1))))
    tables.append(("judged", """SELECT round, client_id, label, decision, 1 / (1 + exp(-decision)) AS proba, CASE WHEN decision > 0 THEN 1 ELSE 0 END AS pred
  FROM (SELECT round, client_id, label, b + x0 * w0 + x1 * w1 + x2 * w2 AS decision FROM strat, models WHERE split = 'test')"""))
    row_loss = HINGE if loss == "hinge" else log_loss_of()
    tables.extend(metric_tables("judged", "round, client_id", row_loss, "mc"))
    tables.append(("near", "SELECT * FROM judged WHERE client_id IN (0, 1, 2)"))
    tables.extend(metric_tables("near", "round", row_loss, "mz"))
    averages = ", ".join(f"sum(n_examples * {n}) / sum(n_examples) AS {n}" for n in LOG_METRICS)
    tables.append(("ma", f"SELECT round, {averages} FROM mc JOIN asks USING (round, client_id) GROUP BY round"))
    return with_(*tables) + f"""SELECT models.round, models.n_examples, {r6('w0')} AS w0, {r6('w1')} AS w1, {r6('w2')} AS w2, {r6('b')} AS intercept,
{rounded(LOG_METRICS, '', 'ma.')}, {rounded(LOG_METRICS, 'central_', 'mz.')} FROM models JOIN ma USING (round) JOIN mz USING (round)"""


SQL["logistic_job"] = whole_job("log_loss", 1.0, 25, 15, 20, [100] * 7)
SQL["svm_job"] = whole_job("hinge", 2.0, 10, 5, 10, [15] * 5 + [30] * 2)
THREE_FEATURES = ("three", "SELECT client_id, label, event_id, value / 100 AS x0, hour / 24 AS x1, dow / 7 AS x2 FROM part")
START3 = ("start", f"SELECT client_id, {draw('0')} AS w0, {draw('1')} AS w1, {draw('2')} AS w2, {draw('3')} AS b FROM (SELECT DISTINCT client_id FROM part)")
SQL["tolerance_stop"] = with_(OBS, part(), THREE_FEATURES, START3, *whole_fit("three", "start", "log_loss", 12, 0.12, "fit")) + f"""SELECT client_id, e AS epochs,
{r6('w0')} AS w0, {r6('w1')} AS w1, {r6('w2')} AS w2, {r6('b')} AS intercept FROM fit"""

SQL["fedavg_logistic"] = job("log_loss", 1.0, 6, 8)
SQL["fedavg_hinge"] = job("hinge", 2.0, 5, 10)
SQL["resumed_run"] = SQL["fedavg_logistic"]
SQL["prepared_clients"] = with_(*prepared_rows(1.0)) + f"SELECT event_id, client_id, label, split, {r6('x0', 5)} AS x0, {r6('x1', 5)} AS x1 FROM strat"
SQL["client_failures"] = with_(
    OBS, part(), ("positives", "SELECT client_id, sum(CASE WHEN client_id IN (1, 4) THEN 0 ELSE label END) AS n FROM part GROUP BY client_id")
) + """SELECT client_id, 'no training rows' AS reason, 'undersample' AS balance FROM positives WHERE n = 0
UNION ALL SELECT client_id, 'one class or no step' AS reason, 'none' AS balance FROM positives WHERE n = 0"""
SQL["incomplete_observations"] = with_(OBS, ("whole", "SELECT * FROM obs WHERE hour > 1"), part(source="whole")) + """SELECT client_id, count(*) AS rows,
sum(label) AS positives FROM part GROUP BY client_id UNION ALL SELECT -1, count(*), NULL FROM obs WHERE hour <= 1"""
