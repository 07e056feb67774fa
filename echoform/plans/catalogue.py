"""Registered queries of the learning engine and their SQL.

Every query reads its whole tables. A fit over very many rows, or by an iterative rule,
has no SQL; tests compare such with a plain fold. Numbers are rounded on both sides, as engines may add in different orders.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from echoform.functions import kernels as native
from echoform.functions import prep
from echoform.functions.vectors import vector
from echoform.operators import compound, metrics
from echoform.operators.merging import merge_close
from echoform.operators.sequences import align, compress_dashes, joined_digits
from echoform.plans import fits, oracles
from echoform.plans.native import native_predict
from echoform.plans.registry import QUERIES, SQL, query
from echoform.sources.tables import table

__all__ = ["QUERIES", "SQL", "fits"]

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flat(x, names, digits=6):
    return [F.round(F.get(x, F.lit(i)), digits).alias(n) for i, n in enumerate(names)]


# Preparation


@query("SELECT " + ", ".join(f"min({c}) + 0.0 AS min_{c}, max({c}) + 0.0 AS max_{c}" for c in NUMBERS) + " FROM lineitem")
def find_bounds(spark, sf_dir):
    b = prep.find_bounds(table(spark, sf_dir, "lineitem"), columns=NUMBERS)
    return b.select(*[F.get(a, F.lit(i)).alias(f"{n}_{c}") for i, c in enumerate(NUMBERS) for a, n in (("d_min", "min"), ("d_max", "max"))])


_BOUNDS = "WITH b AS (SELECT " + ", ".join(f"min({c}) AS a{i}, max({c}) AS z{i}" for i, c in enumerate(NUMBERS)) + " FROM lineitem)"
_SCALED = [f"CASE WHEN z{i} = a{i} THEN 0.0 ELSE ({c} - a{i}) / (z{i} - a{i}) END" for i, c in enumerate(NUMBERS)]


@query(f"{_BOUNDS} SELECT {', '.join(LINE)}, " + ", ".join(f"round({x}, 6) AS n{i}" for i, x in enumerate(_SCALED)) + " FROM lineitem, b")
def normalize(spark, sf_dir):
    rows = prep.prepare(table(spark, sf_dir, "lineitem"), NUMBERS)
    return rows.select(*LINE, *flat(F.col("x"), [f"n{i}" for i in range(4)]))


@query(f"SELECT {', '.join(LINE)}, " + ", ".join(f"round({c}, 6) AS n{i}" for i, c in enumerate(NUMBERS)) + " FROM lineitem")
def de_normalize(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    b = prep.find_bounds(lines, columns=NUMBERS)
    rows = lines.crossJoin(F.broadcast(b)).withColumn("x", prep.normalize(prep.features(*NUMBERS), F.col("d_min"), F.col("d_max")))
    return rows.select(*LINE, *flat(prep.de_normalize(F.col("x"), F.col("d_min"), F.col("d_max")), [f"n{i}" for i in range(4)]))


@query(f"{_BOUNDS} SELECT {', '.join(LINE)}, " + ", ".join(f"round({x}, 6) AS c{i}, round(1 - ({x}), 6) AS c{i + 4}" for i, x in enumerate(_SCALED)) + " FROM lineitem, b")
def complement_code(spark, sf_dir):
    rows = prep.prepare(table(spark, sf_dir, "lineitem"), NUMBERS, complement=True)
    return rows.select(*LINE, *flat(F.col("x"), [f"c{i}" for i in range(8)]))


@query("SELECT p_partkey, round((p_size / 50.0 + 1 - p_retailprice / 4000.0) / 2, 9) AS m FROM part")
def de_complement_code(spark, sf_dir):
    w = prep.features(F.col("p_size") / 50, F.col("p_retailprice") / 4000)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.get(prep.de_complement_code(w), F.lit(0)), 9).alias("m"))


@query("SELECT p_partkey, round(least(greatest(p_size, 10.0), 40.0)::DOUBLE, 6) AS c0, round(least(greatest(p_retailprice, 950.0), 1500.0), 6) AS c1 FROM part")
def clip_rows(spark, sf_dir):
    x = prep.clip(prep.features("p_size", "p_retailprice"), vector([10, 950]), vector([40, 1500]))
    return table(spark, sf_dir, "part").select("p_partkey", *flat(x, ["c0", "c1"]))


@query("SELECT p_partkey, " + ", ".join(f"(floor(p_size / 50.0 * 4) > {i})::INT AS b{i}" for i in range(4)) + ", (p_size / 50.0 > 0.5)::INT AS half FROM part")
def thermometer_encode(spark, sf_dir):
    x = prep.features(F.col("p_size") / 50)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.get(prep.thermometer(x, 4), F.lit(i)).alias(f"b{i}") for i in range(4)], F.get(prep.thermometer(x, 1), F.lit(0)).alias("half"))


@query("SELECT p_partkey, (p_size / 50.0)::DOUBLE >= 1 AS on_bit, (1 - p_size / 50.0)::DOUBLE >= 1 AS off_bit FROM part")
def binary_prepare(spark, sf_dir):
    x = prep.binary(prep.complement_code(prep.features(F.col("p_size") / 50)))
    return table(spark, sf_dir, "part").select("p_partkey", (F.get(x, F.lit(0)) == 1).alias("on_bit"), (F.get(x, F.lit(1)) == 1).alias("off_bit"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount * 12 > 1) AS bad FROM lineitem GROUP BY ALL")
def validate_rows(spark, sf_dir):
    x = prep.complement_code(prep.features(F.col("l_discount") * 12, "l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(prep.invalid(x, "fuzzy", 4)).alias("bad"))


@query("SELECT p_partkey, round(p_size / 50.0, 6) AS a, 0.5::DOUBLE AS b, 0.5::DOUBLE AS c, round(p_retailprice / 4000, 6) AS d FROM part")
def join_split_channels(spark, sf_dir):
    joined = prep.join_channels([prep.features(F.col("p_size") / 50), None, prep.features(F.col("p_retailprice") / 4000)], [1, 2, 1])
    a, b, c = prep.split_channels(joined, [1, 2, 1])
    return table(spark, sf_dir, "part").select("p_partkey", *flat(a, ["a"]), *flat(b, ["b", "c"]), *flat(c, ["d"]))


# Kernels: rows of part as two numbers in [0, 1] against three weights

_X = ("(p_size - 1) / 49.0", "(p_retailprice - 900) / 3000.0")


def _part(spark, sf_dir, complement=False, binary=False):
    x = prep.features((F.col("p_size") - 1) / 49.0, (F.col("p_retailprice") - 900) / 3000.0)
    if binary:
        x = prep.features(F.col("p_size") % 2, F.floor(F.col("p_size") / 2) % 2)
    return table(spark, sf_dir, "part").select("p_partkey", (prep.complement_code(x) if complement else x).alias("x"))


def _kernel_query(name, kernel, weights, size, choice, match, update, new, complement=False, binary=False, cross=True):
    """Registers <name>_choice_match, <name>_update and <name>_new_weight. SQL parts use x1, x2 and w1, w2, ..."""
    xs = (("(p_size % 2)::DOUBLE", "(p_size // 2 % 2)::DOUBLE") if binary else _X) + ()
    x_sql = f"SELECT p_partkey, {xs[0]} AS x1, {xs[1]} AS x2" + (f", 1 - ({xs[0]}) AS x3, 1 - ({xs[1]}) AS x4" if complement else "") + " FROM part"
    w_sql = "(VALUES " + ", ".join("(" + ", ".join([str(k), *[f"{float(v)!r}::DOUBLE" for v in w]]) + ")" for k, w in enumerate(weights)) + ") AS w(k, " + ", ".join(f"w{i + 1}" for i in range(size)) + ")"

    def pairs(spark, sf_dir):
        table_ = F.array(*[F.struct(F.lit(k).alias("k"), vector(w).alias("w")) for k, w in enumerate(weights)])
        return _part(spark, sf_dir, complement, binary).withColumn("_w", F.explode(table_)).select("p_partkey", "x", F.col("_w.k").alias("k"), F.col("_w.w").alias("w"))

    def choice_match(spark, sf_dir):
        return pairs(spark, sf_dir).select("p_partkey", "k", F.round(kernel.choice(F.col("x"), F.col("w")), 6).alias("t"), F.round(kernel.match(F.col("x"), F.col("w")), 6).alias("m"))

    def updated(spark, sf_dir):
        return pairs(spark, sf_dir).withColumn("u", kernel.update(F.col("x"), F.col("w"))).select("p_partkey", "k", *flat(F.col("u"), [f"u{i + 1}" for i in range(size)], 8))

    def new_weight(spark, sf_dir):
        return _part(spark, sf_dir, complement, binary).withColumn("u", kernel.new(F.col("x"))).select("p_partkey", *flat(F.col("u"), [f"u{i + 1}" for i in range(size)], 8))

    for kind, f, sql in (
        ("choice_match", choice_match, f"SELECT p_partkey, k, round({choice}, 6) AS t, round({match}, 6) AS m FROM ({x_sql}), {w_sql}"),
        ("update", updated, f"SELECT p_partkey, k, {', '.join(f'round({u}, 8) AS u{i + 1}' for i, u in enumerate(update))} FROM ({x_sql}), {w_sql}"),
        ("new_weight", new_weight, f"SELECT p_partkey, {', '.join(f'round({u}, 8) AS u{i + 1}' for i, u in enumerate(new))} FROM ({x_sql})"),
    ):
        f.__name__ = f"{name}_{kind}"
        query(sql)(f)


_both = " + ".join(f"least(x{i}, w{i})" for i in range(1, 5))
_kernel_query("fuzzy", native.fuzzy(2, 0.01, 0.5), [(0.1, 0.2, 0.6, 0.5), (0.5, 0.5, 0.4, 0.4), (0, 0, 0, 0.05)], 4, f"({_both}) / (0.01 + w1 + w2 + w3 + w4)", f"({_both}) / 2", [f"0.5 * least(x{i}, w{i}) + 0.5 * w{i}" for i in range(1, 5)], ["x1", "x2", "x3", "x4"], complement=True)
_bin = " + ".join(f"(x{i}::INT & w{i}::INT)" for i in range(1, 5))
_kernel_query("binary_fuzzy", native.fuzzy(2, 0.01, 1.0), [(1, 0, 0, 1), (1, 1, 0, 0), (0, 0, 0, 1)], 4, f"({_bin}) / (0.01 + w1 + w2 + w3 + w4)", f"({_bin}) / 2", [f"(x{i}::INT & w{i}::INT)::DOUBLE" for i in range(1, 5)], ["x1", "x2", "x3", "x4"], complement=True, binary=True)
_kernel_query("art1", native.art1(2, 2.0), [(0.6, 0.6, 1, 1), (1, 0, 1, 0), (0, 1, 0, 1)], 4, "x1 * w1 + x2 * w2", "((x1 <> 0 AND w3 <> 0)::INT + (x2 <> 0 AND w4 <> 0)::INT) / 2", ["(2 / (1 + x1 * w3 + x2 * w4) * x1 * w3)::FLOAT::DOUBLE", "(2 / (1 + x1 * w3 + x2 * w4) * x2 * w4)::FLOAT::DOUBLE", "x1 * w3", "x2 * w4"], ["x1 * 2 / 3", "x2 * 2 / 3", "x1", "x2"], binary=True)
_kernel_query("art2a", native.art2a(0.1, 0.5), [(0.2, 0.8), (0.9, 0.1), (0.02, 0.01)], 2, "x1 * w1 + x2 * w2", "CASE WHEN x1 * w1 + x2 * w2 >= 0.1 * (x1 + x2) THEN x1 * w1 + x2 * w2 ELSE -1 END", ["0.5 * x1 + 0.5 * w1", "0.5 * x2 + 0.5 * w2"], ["x1", "x2"])
_r = "sqrt((x1 - w1) ** 2 + (x2 - w2) ** 2)"
_kernel_query("hypersphere", native.hypersphere(2, 0.01, 0.5, 1.5), [(0.2, 0.3, 0.1), (0.7, 0.6, 0.3), (0.5, 0.5, 0)], 3, f"(1.5 - greatest(w3, {_r})) / (1.51 - w3)", f"1 - greatest(w3, {_r}) / 1.5", [*[f"w{i} + 0.25 * (x{i} - w{i}) * (1 - least(w3, {_r}) / ({_r} + 0.01))" for i in (1, 2)], f"w3 + 0.25 * (greatest(w3, {_r}) - w3)"], ["x1", "x2", "0.0::DOUBLE"])
_s = "((x1 - w1) ** 2 + (x2 - w2) ** 2)"
_e = f"CASE WHEN w3 <> 0 OR w4 <> 0 THEN sqrt(greatest(0, {_s} - 0.36 * (w3 * (x1 - w1) + w4 * (x2 - w2)) ** 2)) / 0.8 ELSE sqrt({_s}) END"
_q = f"(CASE WHEN ({_e}) = 0 THEN 1 ELSE least(w5, {_e}) / ({_e}) END)"
_c = [f"(w{i} + 0.25 * (x{i} - w{i}) * (1 - {_q}))" for i in (1, 2)]
_z = f"sqrt((x1 - {_c[0]}) ** 2 + (x2 - {_c[1]}) ** 2)"
_kernel_query("ellipsoid", native.ellipsoid(2, 0.01, 0.5, 0.8, 2.0), [(0.2, 0.3, 0.6, 0.8, 0.1), (0.7, 0.6, 0, 0, 0.2), (0.5, 0.5, 0, 0, 0)], 5, f"(2 - w5 - greatest(w5, {_e})) / (2.01 - 2 * w5)", f"1 - (w5 + greatest(w5, {_e})) / 2", [*_c, *[f"CASE WHEN w5 <> 0 AND {_z} <> 0 THEN (x{i} - {_c[i - 1]}) / {_z} ELSE w{i + 2} END" for i in (1, 2)], f"w5 + 0.25 * (greatest(w5, {_e}) - w5)"], ["x1", "x2", "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE"])
_g = "exp(-0.5 * ((w1 - x1) ** 2 * w5 + (w2 - x2) ** 2 * w6))"
_m = [f"((1 - 1 / (w8 + 1)) * w{i} + x{i} / (w8 + 1))" for i in (1, 2)]
_v = [f"((1 - 1 / (w8 + 1)) * w{i + 2} ** 2 + ({_m[i - 1]} - x{i}) ** 2 / (w8 + 1))" for i in (1, 2)]
_kernel_query("gaussian", native.gaussian(2, 0.01, 0.5, 9.0), [(0.2, 0.3, 0.5, 0.5, 4, 4, 0.25, 1), (0.7, 0.6, 0.2, 0.4, 25, 6.25, 0.08, 5), (0.5, 0.1, 1, 1, 1, 1, 1, 3)], 8, f"{_g} / (0.01 + w7) * w8 / 9", _g, [*_m, *[f"sqrt({v})" for v in _v], *[f"1 / {v}" for v in _v], f"sqrt({_v[0]} * {_v[1]})", "w8 + 1"], ["x1", "x2", "0.5::DOUBLE", "0.5::DOUBLE", "4.0::DOUBLE", "4.0::DOUBLE", "0.25::DOUBLE", "1.0::DOUBLE"])
_d = "(w3 * w6 - w4 * w5)"
_bm = [f"((1 - 1 / (w7 + 1)) * w{i} + x{i} / (w7 + 1))" for i in (1, 2)]
_bc = [f"(w7 / (w7 + 1) * w{3 + 2 * i + j} + (x{i + 1} - {_bm[i]}) * (x{j + 1} - {_bm[j]}) / (w7 + 1))" for i in (0, 1) for j in (0, 1)]
_kernel_query("bayesian", native.bayesian2(9.0, 0.05), [(0.2, 0.3, 0.1, 0.02, 0.02, 0.2, 1), (0.7, 0.6, 0.05, 0, 0, 0.05, 5), (0.5, 0.1, 0.3, -0.1, -0.1, 0.2, 3)], 7, f"exp(-0.5 * (w6 * (x1 - w1) ** 2 - (w4 + w5) * (x1 - w1) * (x2 - w2) + w3 * (x2 - w2) ** 2) / {_d}) / (2 * pi() * sqrt({_d})) * w7 / 9", f"{_bc[0]} * {_bc[3]} - {_bc[1]} * {_bc[2]}", [*_bm, *_bc, "w7 + 1"], ["x1", "x2", "0.05::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "0.05::DOUBLE", "1.0::DOUBLE"])
_zz = ["(w1 * x1 + w2 * x2)", "(w3 * x1 + w4 * x2)"]
_f = f"(({_zz[0]} - w5) ** 2 + ({_zz[1]} - w6) ** 2)"
_t = f"exp(-w7 * w7 * {_f})"
_p = [f"(2 * w7 * w7 * {_t} * ({_zz[i]} - w{5 + i}))" for i in (0, 1)]
_kernel_query("quadratic", native.quadratic(2, 0.5, 0.1, 0.2, 0.3), [(1, 0, 0, 1, 0.3, 0.3, 0.5), (0.9, 0.1, -0.1, 1.1, 0.6, 0.5, 1.5), (1, 0.2, 0.2, 1, 0, 0, 1)], 7, _t, _t, [*[f"w{2 * i + j + 1} - 0.2 * {_p[i]} * x{j + 1}" for i in (0, 1) for j in (0, 1)], f"w5 + 0.1 * {_p[0]}", f"w6 + 0.1 * {_p[1]}", f"w7 - 0.3 * 2 * w7 * {_t} * {_f}"], ["1.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE", "x1", "x2", "0.5::DOUBLE"])


# Predictions against literal weights

_W = [(0.1, 0.2, 0.6, 0.5), (0.5, 0.5, 0.4, 0.4), (0.8, 0.1, 0.1, 0.8), (0.2, 0.7, 0.7, 0.2)]
_WSQL = "(VALUES " + ", ".join(f"({k}, {w[0]}, {w[1]}, {w[2]}, {w[3]})" for k, w in enumerate(_W)) + ") AS w(k, w1, w2, w3, w4)"
_PX = f"SELECT p_partkey, {_X[0]} AS x1, {_X[1]} AS x2, 1 - ({_X[0]}) AS x3, 1 - ({_X[1]}) AS x4 FROM part"


@query(f"SELECT p_partkey, k::BIGINT AS cluster_id, round(t, 6) AS activation FROM (SELECT p_partkey, k, ({_both}) / (0.01 + w1 + w2 + w3 + w4) AS t, row_number() OVER (PARTITION BY p_partkey ORDER BY ({_both}) / (0.01 + w1 + w2 + w3 + w4) DESC, k) AS r FROM ({_PX}), {_WSQL}) WHERE r = 1")
def predict_argmax(spark, sf_dir):
    got = native_predict(_part(spark, sf_dir, True), _W, native.fuzzy(2, 0.01), keep=("p_partkey",))
    return got.withColumn("activation", F.round("activation", 6))


@query(f"WITH s AS (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY ({_both}) / (0.01 + w1 + w2 + w3 + w4) DESC, k) AS r FROM ({_PX}), {_WSQL} WHERE ({_both}) / 2 >= 0.6) SELECT p_partkey, coalesce(k, 0)::BIGINT AS cluster_id FROM part LEFT JOIN s USING (p_partkey) WHERE coalesce(r, 1) = 1")
def predict_vigilant(spark, sf_dir):
    return native_predict(_part(spark, sf_dir, True), _W, native.fuzzy(2, 0.01), 0.6, keep=("p_partkey",)).select("p_partkey", "cluster_id")


# Fused channels and reinforcement learning

_CH = "(0.5 * (least(p_size / 50.0, 0.4) + least(1 - p_size / 50.0, 0.5)) / (0.01 + 0.9) + 0.5 * (least(p_retailprice / 4000, 0.3) + least(1 - p_retailprice / 4000, 0.6)) / (0.01 + 0.9))"


@query(f"SELECT p_partkey, round({_CH}, 6) AS t, round(0.5 * (least(p_size / 50.0, 0.4) + least(1 - p_size / 50.0, 0.5)) / 0.91 + 0.5, 6) AS t_skip FROM part")
def fusion_choice(spark, sf_dir):
    k = native.fuzzy(1, 0.01)
    a, b = prep.complement_code(prep.features(F.col("p_size") / 50)), prep.complement_code(prep.features(F.col("p_retailprice") / 4000))
    first, second = k.choice(a, vector([0.4, 0.5])), k.choice(b, vector([0.3, 0.6]))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(0.5 * first + 0.5 * second, 6).alias("t"), F.round(0.5 * first + F.lit(0.5), 6).alias("t_skip"))


@query("""SELECT event_id, round(CASE WHEN n = 1 THEN r ELSE least(1.0, greatest(0.0, q + 0.5 * (r + 0.9 * nq - q))) END, 6) AS target
FROM (SELECT event_id, r, q, lead(q) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nq, count(*) OVER (PARTITION BY user_id) AS n
      FROM (SELECT event_id, user_id, ts, least(value / 500, 1.0) AS r, CASE event_type WHEN 'purchase' THEN 0.8 WHEN 'error' THEN 0.1 ELSE 0.4 END AS q FROM events))
WHERE nq IS NOT NULL OR n = 1""")
def sarsa_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("episode_id"), F.struct("ts", "event_id").alias("t"), F.least(F.col("value") / 500, F.lit(1.0)).alias("r"), F.when(F.col("event_type") == "purchase", 0.8).when(F.col("event_type") == "error", 0.1).otherwise(0.4).alias("q"))
    return compound.sarsa(rows, "q", "r", 0.5, 0.9).select("event_id", F.round("target", 6).alias("target"))


@query("SELECT user_id AS sample_id, a AS action_id, round(r, 6) AS reward FROM (SELECT user_id, a, r, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, a) AS k FROM (SELECT user_id, length(event_type) AS a, avg(value) AS r FROM events GROUP BY ALL)) WHERE k = 1")
def best_action(spark, sf_dir):
    rewards = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id"), F.length("event_type").cast("long").alias("action_id")).agg(F.avg("value").alias("reward"))
    return compound.best_action(rewards).withColumn("reward", F.round("reward", 6))


@query("""WITH r AS (SELECT user_id AS s, length(event_type)::BIGINT AS a, avg(value) AS r FROM events GROUP BY ALL),
p AS (SELECT *, greatest(0.0001, least(0.5, r / sum(r) OVER (PARTITION BY s))) AS p FROM r),
c AS (SELECT s, a, sum(p / t) OVER (PARTITION BY s ORDER BY a) AS c FROM (SELECT *, sum(p) OVER (PARTITION BY s) AS t FROM p)),
u AS (SELECT *, ('0x' || substr(md5('0/' || s::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM c)
SELECT s AS sample_id, coalesce(min(a) FILTER (c > u), max(a)) AS action_id FROM u GROUP BY s""")
def probabilistic_action(spark, sf_dir):
    rewards = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id"), F.length("event_type").cast("long").alias("action_id")).agg(F.avg("value").alias("reward"))
    return compound.probabilistic_action(rewards, 0.5)


@query("SELECT s_suppkey, round(acos(greatest(-1, least(1, sin(radians(s_nationkey)) * sin(radians(10.0)) + cos(radians(s_nationkey)) * cos(radians(10.0)) * cos(radians(s_acctbal / 100 - 20.0))))) / pi(), 6) AS angle FROM supplier")
def great_circle(spark, sf_dir):
    a, b = prep.features("s_nationkey", F.col("s_acctbal") / 100), vector([10, 20])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(metrics.great_circle(a, b), 6).alias("angle"))


# Metrics, merging, strings

_PTS = "SELECT s_suppkey AS i, s_nationkey % 5 AS c, s_acctbal / 1000 AS u, s_nationkey::DOUBLE AS v FROM supplier"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_nationkey") % 5).alias("cluster"), prep.features(F.col("s_acctbal") / 1000, "s_nationkey").alias("x"))


@query(f"WITH p AS ({_PTS}), c AS (SELECT c, count(*) AS n, avg(u) AS mu, avg(v) AS mv, var_pop(u) * count(*) + var_pop(v) * count(*) AS ss FROM p GROUP BY c), g AS (SELECT avg(u) AS gu, avg(v) AS gv, count(*) AS n FROM p) SELECT round(sum(c.n * ((mu - gu) ** 2 + (mv - gv) ** 2)) / sum(ss) * (max(g.n) - count(*)) / (count(*) - 1), 6) AS ch FROM c, g")
def calinski_harabasz(spark, sf_dir):
    return metrics.calinski_harabasz(_points(spark, sf_dir)).select(F.round("ch", 6).alias("ch"))


@query(f"WITH p AS ({_PTS}), m AS (SELECT c, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY c), s AS (SELECT c, any_value(mu) AS mu, any_value(mv) AS mv, avg(sqrt((u - mu) ** 2 + (v - mv) ** 2)) AS s FROM p JOIN m USING (c) GROUP BY c) SELECT round(avg(r), 6) AS db FROM (SELECT a.c, max((a.s + b.s) / sqrt((a.mu - b.mu) ** 2 + (a.mv - b.mv) ** 2)) AS r FROM s a JOIN s b ON a.c <> b.c GROUP BY a.c)")
def davies_bouldin(spark, sf_dir):
    return metrics.davies_bouldin(_points(spark, sf_dir)).select(F.round("db", 6).alias("db"))


@query(f"WITH p AS ({_PTS}), d AS (SELECT a.i, a.c, b.c AS o, avg(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) AS m FROM p a JOIN p b ON a.i <> b.i GROUP BY ALL), s AS (SELECT i, max(CASE WHEN c = o THEN m END) AS a, min(CASE WHEN c <> o THEN m END) AS b FROM d GROUP BY i) SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def silhouette(spark, sf_dir):
    return metrics.silhouette(_points(spark, sf_dir)).select(F.round("silhouette", 6).alias("silhouette"))


@query("WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), j AS (SELECT sum(n * (n - 1) / 2) AS j, sum(n) AS m FROM t), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT round((j - x * y / (m * (m - 1) / 2)) / ((x + y) / 2 - x * y / (m * (m - 1) / 2)), 6) AS ari FROM j, x, y")
def adjusted_rand(spark, sf_dir):
    return metrics.adjusted_rand(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("ari", 6).alias("ari"))


@query(f"WITH p AS ({_PTS}) SELECT a.i, b.i AS j, round(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2), 6) AS dist FROM p a, p b")
def pairwise_distances(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_acctbal") / 1000).alias("u"), F.col("s_nationkey").alias("v"))
    return metrics.pairwise_columns(points, ["u", "v"]).withColumn("dist", metrics.rounded(F.col("dist"), 6))


@query(oracles.vat("SELECT c_nationkey::VARCHAR AS g, c_custkey AS i, c_acctbal / 1000 AS u, (c_custkey % 101)::DOUBLE AS v FROM customer"))
def vat_order(spark, sf_dir):
    """The customers of each nation in an order that shows cluster tendency."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("sample_id"), prep.features(F.col("c_acctbal") / 1000, F.col("c_custkey") % 101).alias("x"))
    return metrics.vat_rows(rows, by=["c_nationkey"])


@query("SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_suppkey HAVING count(*) > 2")
def pearson(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), metrics.correlation("l_quantity", "l_extendedprice").alias("r"))
    return got.where("n > 2").select("l_suppkey", F.round("r", 6).alias("r"))


@query("""WITH RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 30),
r(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS s_suppkey, min(b) AS component FROM r GROUP BY a""")
def merge_components(spark, sf_dir):
    return merge_close(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 30.0)


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[aeiou]', '-', 'g'), '-+', '-', 'g') AS s FROM part")
def compress_dashes_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compress_dashes(F.regexp_replace("p_name", "[aeiou]", "-")).alias("s"))


@query("SELECT p_partkey, p_size::VARCHAR || p_retailprice::BIGINT::VARCHAR AS s FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)")
def joined_digits_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", joined_digits(F.array(F.col("p_size").cast("long"), F.floor("p_retailprice"))).alias("s"))


@query(oracles.aligned("part", "p_partkey", "p_name", "small brass ring"))
def needleman_wunsch(spark, sf_dir):
    got = align(F.col("p_name"), F.lit("small brass ring"))
    return table(spark, sf_dir, "part").withColumn("g", got).select("p_partkey", F.col("g.agreement").alias("agreement"), F.round("g.score", 6).alias("score"))


@query("SELECT p_partkey, round(p_size / 50.0, 6) AS low0, round(1 - least(1 - p_size / 50.0, 0.3) - p_size / 50.0, 6) AS width0, round(p_size / 50.0 + 0.1 * (1 - least(1 - p_size / 50.0, 0.3) - p_size / 50.0), 6) AS shrunk0 FROM part")
def boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", prep.features(F.col("p_size") / 50, F.least(1 - F.col("p_size") / 50, F.lit(0.3))).alias("w"))
    w = F.col("w")
    rows = rows.withColumn("low0", F.round(F.get(w, F.lit(0)), 6)).withColumn("width0", F.round(1 - F.get(w, F.lit(1)) - F.get(w, F.lit(0)), 6))
    return compound.shrink(rows, 0.1).select("p_partkey", "low0", "width0", F.round(F.get("w", F.lit(0)), 6).alias("shrunk0"))


@query(f"WITH {oracles.CUSTOMER} SELECT i AS sample_id, round((u + 1 - (1 - u)) / 2, 6) AS c0, round(v, 6) AS c1 FROM n")
def fuzzy_centres(spark, sf_dir):
    rows = fits.customers(spark, sf_dir, True)
    return rows.select("sample_id", *flat(prep.de_complement_code(F.col("x")), ["c0", "c1"]))


@query()
def keyed_row_order(spark, sf_dir):
    """Running best value of each user's events, the smoothing of learning curves."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max("value").over(w).alias("best"))


SQL["keyed_row_order"] = "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events"


