"""Registered fits: a model for each key of a table, learnt side by side, and their SQL.

Keys: customers by nation, line items by supplier or by return flag and status, vectors
by shard (id modulo 10), parts by brand, events by user. The SQL learns one row of every
model at a time (oracles.py). Numbers are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoform.functions import kernels as native
from echoform.functions import prep
from echoform.functions.preparation import Preparation
from echoform.operators import compound
from echoform.operators.kernels import ART1, ART2A, Bayesian, BinaryFuzzy, Ellipsoid, Fuzzy, Gaussian, Hypersphere, QuadraticNeuron
from echoform.operators.learners import Clusterer, Deep, DualVigilance, Fusion, MapClassifier, Mapped, OnlineValidity, Smart, Topology, TwoSided
from echoform.operators.sequences import SequenceClusterer
from echoform.operators.train import Fitted, apply, first_label, fold
from echoform.plans import oracles
from echoform.plans.native import native_fit
from echoform.plans.registry import query
from echoform.sources.tables import table

#: Columns of the embeddings table's vectors.
DIMENSIONS = 64
NATION, SHARD, SUPPLIER, SEGMENT, BRAND, USER = ["c_nationkey"], ["shard"], ["l_suppkey"], ["l_returnflag", "l_linestatus"], ["p_brand"], ["user_id"]


def customers(spark, sf_dir, complement):
    """Customers with a spread of their keys and their balance, scaled."""
    rows = table(spark, sf_dir, "customer").withColumn("spread", F.col("c_custkey") % 101)
    return prep.prepare(rows, ["spread", "c_acctbal"], complement).select(F.col("c_custkey").alias("sample_id"), "c_nationkey", "x")


def labels_of(fitted: Fitted) -> DataFrame:
    return fitted.labels.select("model", "sample_id", first_label().alias("cluster_id"))


def of_customers(x: str) -> str:
    return f"{oracles.CUSTOMER}, p AS (SELECT g, i, k, {x} AS x FROM n)"


# Elementary models: customers of each nation


def bits(spark, sf_dir, complement):
    rows = customers(spark, sf_dir, False)
    out = prep.thermometer(F.col("x"), 4).cast("array<double>")
    return rows.withColumn("x", prep.complement_code(out) if complement else out)


def _elementary(name, kernel, terms, x="[u, v]", rows=lambda s, d: customers(s, d, False)):
    query(oracles.fit(of_customers(x), terms), f"{name}_fit")(lambda spark, sf_dir: labels_of(fold(rows(spark, sf_dir), Clusterer(kernel), "sample_id", ["x"], NATION)))


_DOT = "list_sum(list_transform(list_zip(x, w), lambda z: z[1] * z[2]))"
_elementary("fuzzy", Fuzzy(0.8, 0.01, 1.0), oracles.fuzzy(0.8, 0.01), oracles.CODED, lambda s, d: customers(s, d, True))
_elementary("hypersphere", Hypersphere(0.85, 1e-10, 1.0, 1.5), oracles.hypersphere(0.85, 1e-10, 1.5))
_elementary("art2a", ART2A(0.3, 0.1, 0.5), oracles.Terms(_DOT, f"(CASE WHEN {_DOT} >= 0.1 * list_sum(x) THEN {_DOT} ELSE -1 END)", 0.3, "list_transform(list_zip(x, w), lambda z: 0.5 * z[1] + 0.5 * z[2])", "x"))
_elementary("ellipsoid", Ellipsoid(0.6, 0.01, 1.0, 0.8, 1.5), oracles.ellipsoid(0.6, 0.01, 0.8, 1.5))
_elementary("gaussian", Gaussian(0.3, 1e-10, (0.2,)), oracles.gaussian(0.3, 1e-10, 0.2, 2))
_elementary("bayesian", Bayesian(5e-4, ((0.01,),)), oracles.bayesian(5e-4, 0.01))
_elementary("quadratic", QuadraticNeuron(0.9, 0.9), oracles.quadratic(0.9, 0.9, 0.1))
_elementary("art1", ART1(0.5, 2.0), oracles.art1(0.5, 2.0), oracles.BITS, lambda s, d: bits(s, d, False))
_elementary("binary_fuzzy", BinaryFuzzy(0.7, 0.01), oracles.fuzzy(0.7, 0.01), oracles.BITS_CODED, lambda s, d: bits(s, d, True))


@query(oracles.fit(of_customers(oracles.CODED), oracles.fuzzy(0.8, 0.01)))
def native_fuzzy_fit(spark, sf_dir):
    """The same fit as one Catalyst plan without Python."""
    return native_fit(customers(spark, sf_dir, True), native.fuzzy(2, 0.01, 1.0), 0.8, by=NATION)


@query(oracles.at_step(of_customers("[u, v]"), oracles.hypersphere(0.85, 1e-10, 1.5), 20))
def weights_by_step(spark, sf_dir):
    """The balls of each nation as they were after twenty customers, from the log of changes of a whole fit."""
    fitted = fold(customers(spark, sf_dir, False), Clusterer(Hypersphere(0.85, 1e-10, 1.0, 1.5)), "sample_id", ["x"], NATION, history=True)
    return fitted.at(20).select("model", "cluster_id", F.transform("w", lambda v: F.round(v, 6)).alias("w"))


# Fitted preparation: bounds of the first half of the customers, used for all


_KEYS = ["c_custkey", "c_acctbal"]
_HALF = """b AS (SELECT min(c_custkey) AS a0, max(c_custkey) AS z0, min(c_acctbal) AS a1, max(c_acctbal) AS z1 FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal BETWEEN 0 AND 9000)"""


def half_prepared(spark, sf_dir, clip=False):
    """(all customers, a preparation fitted on those with even keys and usual balances)."""
    rows = table(spark, sf_dir, "customer")
    return rows, Preparation.of({"id": ["c_custkey"], "money": ["c_acctbal"]}, clip=clip).fit(rows.where("c_custkey % 2 = 0 AND c_acctbal BETWEEN 0 AND 9000"))


@query(f"WITH {_HALF} SELECT c_custkey, list_filter([CASE WHEN c_custkey NOT BETWEEN a0 AND z0 THEN 'id' END, CASE WHEN c_acctbal NOT BETWEEN a1 AND z1 THEN 'money' END], lambda v: v IS NOT NULL) AS refused FROM customer, b")
def refused_rows(spark, sf_dir):
    """Which channels of each customer a fitted preparation refuses."""
    rows, model = half_prepared(spark, sf_dir)
    return model.refused(rows).select("c_custkey", "refused")


@query(f"WITH {_HALF} SELECT c_custkey AS sample_id, round(greatest(a0, least(z0, c_custkey))::DOUBLE, 6) AS id, round(greatest(a1, least(z1, c_acctbal))::DOUBLE, 6) AS money FROM customer, b")
def restored_channels(spark, sf_dir):
    """Two channels prepared, joined, split and restored: the numbers themselves, held to the bounds."""
    rows, model = half_prepared(spark, sf_dir, clip=True)
    got = model.transform(rows.withColumn("sample_id", F.col("c_custkey"))).withColumn("joined", model.joined())
    for channel, part in model.split(F.col("joined")).items():
        got = model.restore(got.withColumn(channel, part), channel)
    return got.select("sample_id", F.round("c_custkey", 6).alias("id"), F.round("c_acctbal", 6).alias("money"))


_USUAL = """b AS (SELECT min(c_custkey % 101)::DOUBLE AS a0, max(c_custkey % 101)::DOUBLE AS z0, min(c_acctbal) AS a1, max(c_acctbal) AS z1 FROM customer WHERE c_acctbal BETWEEN 0 AND 9000),
n AS (SELECT c_nationkey::VARCHAR AS g, c_custkey AS i, c_acctbal BETWEEN 0 AND 9000 AS usual, ((c_custkey % 101) - a0) / (z0 - a0) AS u, (greatest(a1, least(z1, c_acctbal)) - a1) / (z1 - a1) AS v FROM customer, b),
p AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY i) AS k, [u, v, 1 - u, 1 - v] AS x FROM n WHERE usual)"""


@query(oracles.predicted(_USUAL, oracles.fuzzy(0.8, 0.01), "SELECT g, i, [u, v, 1 - u, 1 - v] AS x FROM n"))
def clipped_prediction(spark, sf_dir):
    """Models of customers with usual balances, and what they say of all customers once those are clipped to the bounds."""
    rows = table(spark, sf_dir, "customer").withColumn("spread", F.col("c_custkey") % 101).withColumn("sample_id", F.col("c_custkey"))
    usual = rows.where("c_acctbal BETWEEN 0 AND 9000")
    model = Preparation.of({"x": ["spread", "c_acctbal"]}).fit(usual)
    fitted = fold(model.transform(usual), Clusterer(Fuzzy(0.8, 0.01, 1.0)), "sample_id", ["x"], NATION)
    return apply(model.clipping().transform(rows), fitted, ["x"], by=NATION).select("model", "sample_id", first_label().alias("cluster_id"))


_EMBEDDED_BITS = "list_transform(embedding, lambda v: (v > 0)::INT)"


@query(f"WITH e AS (SELECT vec_id, vec_id % 10 AS shard, list_concat({_EMBEDDED_BITS}, list_transform({_EMBEDDED_BITS}, lambda v: 1 - v)) AS x FROM embeddings), h AS (SELECT shard, arg_min(x, vec_id) AS w FROM e GROUP BY shard) SELECT vec_id AS sample_id, round(list_sum(list_transform(list_zip(x, w), lambda z: z[1] * z[2])) / (0.01 + list_sum(w)), 6) AS choice, round(list_sum(list_transform(list_zip(x, w), lambda z: z[1] * z[2])) / 64.0, 6) AS match FROM e JOIN h USING (shard)")
def packed_bits_choice(spark, sf_dir):
    """Choice and match of each vector's signs against the first vector of its shard, on packed bits: an AND and a count of bits."""
    x = prep.complement_code(F.transform("embedding", lambda v: (v > 0).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("shard"), prep.pack_bits(x).alias("x"))
    first = rows.groupBy("shard").agg(F.min_by("x", "vec_id").alias("w"))
    both, size = prep.overlap(F.col("x"), F.col("w")), prep.overlap(F.col("w"), F.col("w"))
    return rows.join(first, "shard").select(F.col("vec_id").alias("sample_id"), F.round(both / (F.lit(0.01) + size), 6).alias("choice"), F.round(both / DIMENSIONS, 6).alias("match"))


# Line items


def lines(spark, sf_dir):
    """lineitem with complement-coded numbers, in order of order and line; rows that tie are ordered by their numbers."""
    rows = prep.prepare(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], complement=True)
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id"), *SEGMENT, *SUPPLIER, "x")


def of_lines(*by: str) -> str:
    names = [("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t")]
    bounds = ", ".join(f"min({c})::DOUBLE AS low_{n}, max({c})::DOUBLE AS high_{n}" for c, n in names)
    plain = ", ".join(f"CASE WHEN high_{n} = low_{n} THEN 0 ELSE ({c} - low_{n}) / (high_{n} - low_{n}) END" for c, n in names)
    return f"""b AS (SELECT {bounds} FROM lineitem),
n AS (SELECT concat_ws('|', {", ".join(by)}) AS g, l_orderkey * 8 + l_linenumber AS i, [{plain}] AS plain FROM lineitem, b),
p AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY i, plain) AS k, list_concat(plain, list_transform(plain, lambda v: 1 - v)) AS x FROM n)"""


@query(oracles.sizes(of_lines(*SEGMENT), oracles.fuzzy(0.6, 0.01)))
def fuzzy_fit_segments(spark, sf_dir):
    """A model for each return flag and status over all of lineitem: how many rows each category learnt."""
    fitted = fold(lines(spark, sf_dir), Clusterer(Fuzzy(0.6, 0.01, 1.0)), "sample_id", ["x"], by=SEGMENT, packed=True)
    return fitted.weights.select("model", "cluster_id", "n")


@query(oracles.applied(of_lines(*SUPPLIER), oracles.fuzzy(0.6, 0.01)))
def fuzzy_fit_predict_lineitem(spark, sf_dir):
    """A model for each supplier, and where it puts the supplier's rows once it has learnt them all."""
    rows = lines(spark, sf_dir)
    fitted = fold(rows, Clusterer(Fuzzy(0.6, 0.01, 1.0)), "sample_id", ["x"], by=SUPPLIER)
    return apply(rows, fitted, ["x"], by=SUPPLIER).groupBy("model", first_label().alias("cluster_id")).agg(F.count("*").alias("n"))


@query(oracles.topology(of_lines(*SUPPLIER), oracles.fuzzy(0.6, 0.01), 0.5, 100, 5))
def topo_edges(spark, sf_dir):
    fitted = fold(lines(spark, sf_dir), Topology(Fuzzy(0.6, 0.01, 1.0), 0.5, tau=100, phi=5), "sample_id", ["x"], by=SUPPLIER)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("links") / 2 - 1, F.lit(-1)).cast("int")), lambda i: F.struct(F.get("links", 2 * i).alias("dst"), F.get("links", 2 * i + 1).alias("weight")))
    edges = fitted.weights.where((F.col("module") == "a") & (F.size("links") > 0)).select("model", F.col("cluster_id").cast("long").alias("src"), F.explode(pairs).alias("e"))
    return edges.select("model", "src", F.col("e.dst").alias("dst"), F.col("e.weight").alias("weight"))


@query(oracles.topology(of_lines(*SUPPLIER), oracles.fuzzy(0.6, 0.01), 0.5, 100, 5, labels=True))
def topo_labels(spark, sf_dir):
    """Rows of each category that a supplier's topology has left, once all labels are brought to its last numbering."""
    rows = lines(spark, sf_dir)
    fitted = fold(rows, Topology(Fuzzy(0.6, 0.01, 1.0), 0.5, tau=100, phi=5), "sample_id", ["x"], by=SUPPLIER, carry=True)
    return compound.relabel(rows, fitted, ["x"], by=SUPPLIER).groupBy("model", "cluster_id").agg(F.count("*").alias("n"))


# Supervised models: vectors of each shard


def embedded(spark, sf_dir):
    """All embeddings scaled to [0, 1] by the bounds of a cosine, complement-coded."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + 1) / 2)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 10).alias("shard"), prep.complement_code(x).alias("x"), x.alias("plain"), F.col("label").cast("long").alias("y"))


_PLAIN = "list_transform(embedding, lambda v: greatest(0.0, least(1.0, (v::DOUBLE + 1) / 2)))"
CODED = "list_concat(plain, list_transform(plain, lambda v: 1 - v))"


def of_embeddings(x: str) -> str:
    """The same rows in SQL: p(g, i, k, x, y), x from a list of plain numbers."""
    return f"e AS (SELECT (vec_id % 10)::VARCHAR AS g, vec_id AS i, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS k, {_PLAIN} AS plain, label::BIGINT AS y FROM embeddings), p AS (SELECT g, i, k, {x} AS x, y FROM e)"


def of_all_embeddings(x: str) -> str:
    """The same rows in SQL as those of one model."""
    return of_embeddings(x).replace("(vec_id % 10)::VARCHAR AS g", "''::VARCHAR AS g").replace("PARTITION BY vec_id % 10 ORDER BY", "ORDER BY")


def predicted(rows: DataFrame, fitted: Fitted, x: str, by=SHARD) -> DataFrame:
    got = apply(rows.withColumn("y", F.lit(0)), fitted, [x, "y"], by=by)
    return got.select("model", "sample_id", first_label().alias("cluster_id"), F.get("labels", F.lit(1)).alias("predicted"))


def _artmap(name, kernel, terms, method="MT+", vigilant=False, x="x", by=SHARD):
    def f(spark, sf_dir):
        rows = embedded(spark, sf_dir)
        return predicted(rows, fold(rows, MapClassifier(kernel, method, vigilant=vigilant), "sample_id", [x, "y"], by), x, by)

    query(oracles.artmap((of_embeddings if by else of_all_embeddings)(CODED if x == "x" else "plain"), terms, method, vigilant=vigilant), name)(f)


for _method, _suffix in (("MT+", ""), ("MT-", "_mt_minus"), ("MT0", "_mt_zero"), ("MT1", "_mt_one"), ("MT~", "_mt_tilde")):
    # One model of all vectors for these, which is a serial stream by the definition of the model.
    _artmap(f"simple_artmap{_suffix}", Fuzzy(0.7, 1e-10, 1.0), oracles.fuzzy(0.7, 1e-10), _method, by=() if _suffix in ("", "_mt_minus") else SHARD)
_artmap("fuzzy_artmap", Fuzzy(0.7, 1e-10, 1.0), oracles.fuzzy(0.7, 1e-10), vigilant=True, by=())
_artmap("hypersphere_artmap", Hypersphere(0.7, 1e-10, 1.0, 3.0), oracles.hypersphere(0.7, 1e-10, 3.0), vigilant=True, x="plain")
_artmap("gaussian_artmap", Gaussian(0.05, 1e-10, (0.2,)), oracles.gaussian(0.05, 1e-10, 0.2, DIMENSIONS), vigilant=True, x="plain")


@query(oracles.artmap(of_all_embeddings(CODED.replace("plain", "list_transform(plain, lambda v: (v > 0.5)::INT::DOUBLE)")), oracles.fuzzy(0.6, 1e-10)))
def binary_fuzzy_artmap(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("x", prep.complement_code(prep.thermometer(F.col("plain"), 1).cast("array<double>")))
    return predicted(rows, fold(rows, MapClassifier(BinaryFuzzy(0.6, 1e-10)), "sample_id", ["x", "y"]), "x", ())


_PARTS = f"""{oracles.scaled("part", "p_brand", "p_partkey", "p_size", "p_retailprice")},
c AS (SELECT min(p_size * p_size)::DOUBLE AS a, max(p_size * p_size)::DOUBLE AS z FROM part),
p AS (SELECT g, i, k, [u, v, 1 - u, 1 - v] AS x, [(p_size * p_size - a) / (z - a), 1 - (p_size * p_size - a) / (z - a)] AS t FROM n JOIN part ON i = p_partkey, c)"""


@query(oracles.two_sided(_PARTS, oracles.fuzzy(0.8, 0.01), oracles.fuzzy(0.9, 0.01)))
def artmap_regression(spark, sf_dir):
    """The square of a part's size from size and price, for each brand."""
    parts = table(spark, sf_dir, "part").withColumn("area", F.col("p_size") * F.col("p_size"))
    rows = prep.prepare(parts, ["p_size", "p_retailprice"], complement=True)
    rows = prep.prepare(rows, ["area"], complement=True, out="t").select(F.col("p_partkey").alias("sample_id"), *BRAND, "x", "t")
    fitted = fold(rows, TwoSided(Fuzzy(0.8, 0.01), Fuzzy(0.9, 0.01)), "sample_id", ["x", "t"], BRAND)
    got = compound.regress(rows, fitted, ["x", "t"], by=BRAND)
    return got.select("model", "sample_id", "cluster_b", F.round(F.get("value", F.lit(0)), 6).alias("value"))


# Compound models


@query(oracles.dual(of_customers(oracles.CODED), oracles.fuzzy(0.85, 0.01), 0.6))
def dual_vigilance(spark, sf_dir):
    return labels_of(fold(customers(spark, sf_dir, True), DualVigilance(Fuzzy(0.85, 0.01), 0.6), "sample_id", ["x"], NATION))


@query(oracles.smart(of_customers(oracles.CODED), [oracles.fuzzy(r, 0.01) for r in (0.5, 0.7, 0.9)]))
def smart_levels(spark, sf_dir):
    fitted = fold(customers(spark, sf_dir, True), Smart(Fuzzy(0.5, 0.01), (0.5, 0.7, 0.9)), "sample_id", ["x"], NATION)
    return fitted.labels.select("model", "sample_id", *[F.get("labels", F.lit(i)).alias(f"level{i}") for i in range(3)])


@query(oracles.deep(of_embeddings(CODED), [oracles.fuzzy(0.6, 1e-10), oracles.fuzzy(0.75, 1e-10)]))
def deep_map(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("x0", F.col("x")).withColumn("x1", F.col("x"))
    fitted = fold(rows, Deep((Fuzzy(0.6, 1e-10), Fuzzy(0.75, 1e-10))), "sample_id", ["x0", "x1", "y"], SHARD)
    return apply(rows, fitted, ["x0", "x1", "y"], by=SHARD).select("model", "sample_id", *[F.get("labels", F.lit(i)).alias(f"level{i}") for i in range(3)])


def events(spark, sf_dir):
    rows = prep.prepare(table(spark, sf_dir, "events").withColumn("hour", F.hour("ts") + F.minute("ts") / 60), ["value", "hour"], complement=True)
    kind = prep.complement_code(F.transform(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]), lambda k: (k == F.col("event_type")).cast("double")))
    return rows.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("episode_id"), "user_id", F.struct("ts", "event_id").alias("t"), F.col("x").alias("state"), kind.alias("action"), F.col("value"), "event_type")


EVENTS = """h AS (SELECT *, (hour(ts) + minute(ts) / 60) AS hour FROM events),
b AS (SELECT min(value)::DOUBLE AS a0, max(value)::DOUBLE AS z0, min(hour)::DOUBLE AS a1, max(hour)::DOUBLE AS z1 FROM h),
n AS (SELECT *, CASE WHEN z0 = a0 THEN 0 ELSE (value - a0) / (z0 - a0) END AS u, CASE WHEN z1 = a1 THEN 0 ELSE (hour - a1) / (z1 - a1) END AS v, list_transform(['click', 'error', 'purchase', 'signup', 'view'], lambda t: (t = event_type)::INT::DOUBLE) AS kind FROM h, b),
c AS (SELECT user_id::VARCHAR AS g, event_id AS i, user_id, ts, event_type, value, [u, v, 1 - u, 1 - v] AS x0, list_concat(kind, list_transform(kind, lambda q: 1 - q)) AS x1 FROM n)"""
_TWO = [oracles.fuzzy(0.6, 0.01), oracles.fuzzy(0.7, 0.01)], [0.5, 0.5]
_FUSED = f"WITH RECURSIVE {EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM c), {oracles.fused(*_TWO)}, q AS (SELECT p.g, i, ws, {oracles.chosen(*_TWO, (1,))} AS best FROM p JOIN z ON p.g = z.g)"


def fused(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows, fold(rows, Fusion((Fuzzy(0.6, 0.01), Fuzzy(0.7, 0.01)), (0.5, 0.5)), "sample_id", ["state", "action"], USER)


@query(f"{_FUSED} SELECT g AS model, i AS sample_id, best - 1 AS cluster_id FROM q")
def fusion_predict_skip(spark, sf_dir):
    rows, fitted = fused(spark, sf_dir)
    return compound.fusion_predict(rows, fitted, ["state", None], by=USER).select("model", "sample_id", first_label().alias("cluster_id"))


@query(f"{_FUSED} SELECT g AS model, i AS sample_id, (best - 1)::INT AS cluster_id, round((ws[best][2][1] + 1 - ws[best][2][6]) / 2, 6) AS click FROM q")
def fusion_regression(spark, sf_dir):
    rows, fitted = fused(spark, sf_dir)
    got = compound.fusion_regress(rows, fitted, ["state", "action"], [1], by=USER)
    return got.select("model", "sample_id", "cluster_id", F.round(F.get(F.get("values", F.lit(0)), F.lit(0)), 6).alias("click"))


_ACTIONS = ["click", "error", "purchase", "signup", "view"]
_AGENT = [oracles.fuzzy(r, 0.01) for r in (0.5, 0.7, 0.9)], [0.33, 0.33, 0.34]
_CODES = [(k, "[" + ", ".join(f"{float(v)}" for v in [*(a == b for b in _ACTIONS), *(a != b for b in _ACTIONS)]) + "]") for k, a in enumerate(_ACTIONS)]


@query(oracles.temporal(EVENTS.replace("AS x1 FROM n)", "AS x1, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, least(value / 500, 1.0) AS r FROM n)"), *_AGENT, 0.5, 0.9, 3, _CODES))
def td_falcon(spark, sf_dir):
    """An agent for each user, taught by three rounds of temporal differences over the user's events; the best action of every state it has met."""
    rows = events(spark, sf_dir).withColumn("reward", F.least(F.col("value") / 500, F.lit(1.0)))
    agent = compound.Falcon((Fuzzy(0.5, 0.01), Fuzzy(0.7, 0.01), Fuzzy(0.9, 0.01)), td_alpha=0.5, td_lambda=0.9, by=USER)
    agent.td(rows, rounds=3)
    code = lambda a: prep.complement_code(F.array(*[F.lit(float(a == b)) for b in _ACTIONS]))
    actions = spark.range(len(_ACTIONS)).select(F.col("id").alias("action_id"), F.get(F.array(*[code(a) for a in _ACTIONS]), F.col("id").cast("int")).alias("action"))
    return agent.best_action(rows, actions).withColumn("reward", F.round("reward", 12))


# Predicates, hooks and modules

_MODULE = [oracles.fuzzy(0.6, 0.01)] * 2, [0.5, 0.5]
EVENTS_MAPPED = EVENTS.replace("[u, v, 1 - u, 1 - v] AS x0, list_concat(kind, list_transform(kind, lambda q: 1 - q)) AS x1 FROM n)", "[u, 1 - u] AS x0, [v, 1 - v] AS x1, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT AS y FROM n)") + ", p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM c)"


@query(oracles.capped(of_customers(oracles.CODED), oracles.fuzzy(0.6, 0.01), 6))
def capped_fit(spark, sf_dir):
    """Categories of at most six customers: a predicate on the category's number of rows."""
    return labels_of(fold(customers(spark, sf_dir, True), Clusterer(Fuzzy(0.6, 0.01)), "sample_id", ["x"], NATION, allowed=lambda row, j, own, memory: own.cats.n[j] < 6))


def _remember(row, labels, own, memory):
    memory["last"] = labels[0]


@query(oracles.allowed(of_customers(oracles.CODED), oracles.fuzzy(0.6, 0.01), "j - 1 <> c"))
def alternating_fit(spark, sf_dir):
    """No category takes two customers of a nation in a row: a hook remembers the last one, a predicate refuses it."""
    fitted = fold(customers(spark, sf_dir, True), Clusterer(Fuzzy(0.6, 0.01)), "sample_id", ["x"], NATION, allowed=lambda row, j, own, memory: j != memory.get("last", -1), hooks=(None, _remember))
    return labels_of(fitted)


@query(oracles.mapped_fused(EVENTS_MAPPED, *_MODULE))
def mapped_fusion(spark, sf_dir):
    """The kind of each user's events from two fused channels, value and hour: fused channels as the module of a map."""
    rows = events(spark, sf_dir).withColumn("y", F.array_position(F.array(*[F.lit(a) for a in _ACTIONS]), F.col("event_type")))
    pick = lambda i: F.array(F.get("state", F.lit(i)), F.get("state", F.lit(i + 2)))
    rows = rows.withColumn("x0", pick(0)).withColumn("x1", pick(1))
    fitted = fold(rows, Mapped(Fusion(tuple(Fuzzy(0.6, 0.01) for _ in range(2)), (0.5, 0.5))), "sample_id", ["x0", "x1", "y"], USER)
    got = apply(rows, fitted, ["x0", "x1"], by=USER)
    return got.select("model", "sample_id", first_label().alias("cluster_id"), F.get("labels", F.lit(1)).alias("predicted"))


_SALES = """sold AS (SELECT o_orderpriority AS g, c_nationkey AS a, s_nationkey AS b, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
full_grid AS (SELECT w.g, x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b, round(coalesce(v, 0) / max(v) OVER (PARTITION BY w.g), 9) AS m FROM (SELECT DISTINCT g FROM sold) w CROSS JOIN nation x CROSS JOIN nation y LEFT JOIN sold ON sold.g = w.g AND sold.a = x.n_nationkey AND sold.b = y.n_nationkey)"""


@query(oracles.biclusters(_SALES, oracles.fuzzy(0.75, 0.01), oracles.fuzzy(0.75, 0.01), 0.01))
def bartmap(spark, sf_dir):
    """For each order priority, biclusters of nations: what customers of one nation bought from suppliers of another, as shares of the largest sum."""
    named = lambda t, key, nation, out: table(spark, sf_dir, t).select(F.col(key).alias(key), F.col(nation).alias(out))
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(named("supplier", "s_suppkey", "s_nationkey", "b").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority").join(named("customer", "c_custkey", "c_nationkey", "a"), "c_custkey")
    cells = sold.join(orders, "l_orderkey").groupBy("o_orderpriority", "a", "b").agg(F.sum("l_extendedprice").alias("v"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    grid = cells.select("o_orderpriority").distinct().crossJoin(nations.select(F.col("n_nationkey").alias("a"))).crossJoin(nations.select(F.col("n_nationkey").alias("b")))  # 25 x 25 cells for each priority
    full = grid.join(cells, ["o_orderpriority", "a", "b"], "left").withColumn("m", F.round(F.coalesce("v", F.lit(0.0)) / F.max("v").over(Window.partitionBy("o_orderpriority")), 9))

    def matrix(row, column):
        out = full.groupBy("o_orderpriority", F.col(row).cast("long").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(column, "m"))), lambda s: s["m"]).alias("raw"))
        return out.withColumn("x", prep.complement_code(F.col("raw")))

    _, _, masks = compound.bicluster(matrix("a", "b"), matrix("b", "a"), Fuzzy(0.75, 0.01), Fuzzy(0.75, 0.01), 0.01, by=["o_orderpriority"])
    return masks.select("model", "row_cluster", "column_cluster", F.array_join("rows", ",").alias("rows"), F.array_join("columns", ",").alias("columns"))


@query(oracles.guided(of_customers(oracles.CODED), oracles.fuzzy(0.5, 0.01)))
def validity_guided(spark, sf_dir):
    return compound.validity_guided(customers(spark, sf_dir, True), Fuzzy(0.5, 0.01), "ch", NATION)


#: Tasks that nations are dealt to by their keys, 0 to 24, so that no two long fits meet in one by chance.
NATIONS = 25


@query(oracles.online_validity(of_customers(oracles.CODED), oracles.fuzzy(0.5, 0.01)))
def online_validity(spark, sf_dir):
    task = F.pmod(F.coalesce("c_nationkey", F.lit(0)), F.lit(NATIONS))
    return labels_of(fold(customers(spark, sf_dir, True), OnlineValidity(Fuzzy(0.5, 0.01)), "sample_id", ["x"], NATION, task=task, tasks=NATIONS))


@query(oracles.offline_validity(of_customers(oracles.CODED), oracles.fuzzy(0.5, 0.01)))
def offline_validity(spark, sf_dir):
    return compound.validity_offline(customers(spark, sf_dir, True), Fuzzy(0.5, 0.01), NATION)


@query(oracles.swept(f"SELECT i, {CODED} AS x, y FROM (SELECT vec_id AS i, {_PLAIN} AS plain, label::BIGINT AS y FROM embeddings)", [(str({"rho": r, "beta": b}), oracles.slow(oracles.fuzzy(r, 0.01), b)) for r in (0.5, 0.6, 0.7, 0.8) for b in (0.5, 1.0)]))
def parameter_sweep(spark, sf_dir):
    rows = embedded(spark, sf_dir).select("sample_id", "x", "y")
    got = compound.sweep(rows, Fuzzy(0.5, 0.01), {"rho": [0.5, 0.6, 0.7, 0.8], "beta": [0.5, 1.0]})
    return got.withColumn("ari", F.round("ari", 6))


@query(oracles.cross_validated(f"SELECT i, {CODED} AS x, y FROM (SELECT vec_id AS i, {_PLAIN} AS plain, label::BIGINT AS y FROM embeddings)", "'{{''kernel__rho'': {0!r}}}'", lambda v: oracles.fuzzy(v, 1e-10), [0.5, 0.6, 0.7], 3, "rho"))
def cross_validated_sweep(spark, sf_dir):
    """Three vigilances of a classifier in three folds: nine models of one fit."""
    return compound.cross_validate(embedded(spark, sf_dir), MapClassifier(Fuzzy(0.5, 1e-10)), {"kernel__rho": [0.5, 0.6, 0.7]})


@query()
def sequence_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), *BRAND, F.col("p_name").alias("x"))
    return labels_of(fold(rows, SequenceClusterer(0.0), "sample_id", ["x"], BRAND))


@query(oracles.fit(of_customers(oracles.CODED), oracles.fuzzy(0.8, 0.01)))
def stream_partial_fit(spark, sf_dir):
    """customers learnt from a file stream, as micro-batches, with a model for each nation; the labels of all batches."""
    import uuid

    from echoform.sources.tables import shared_folder
    from echoform.streaming.partial import partial_fit

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = customers(spark, sf_dir, True).select("sample_id", *NATION, "x")
    # Three parts that arrive one after the other, each with rows of all nations.
    parts = rows.select(F.max("sample_id")).first()[0] // 3 + 1
    for k in range(3):
        rows.where(F.floor(F.col("sample_id") / parts) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("sample_id long, c_nationkey int, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    partial_fit(stream, f"{root}/model", f"{root}/checkpoint", Clusterer(Fuzzy(0.8, 0.01, 1.0)), "sample_id", ["x"], NATION, availableNow=True).awaitTermination()
    return spark.read.parquet(f"{root}/model/*/labels").select("model", "sample_id", first_label().alias("cluster_id"))
