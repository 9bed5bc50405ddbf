"""Queries on sets, roles, neighbours, reshaping and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsight.functions import distributions
from lapsight.operators import relations
from lapsight.plans.registry import query, rounded, table


@query(
    "relational_division",
    """
SELECT o_custkey, count(DISTINCT o_orderpriority) AS members FROM orders GROUP BY 1
HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""",
)
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.has_all(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    "semi_anti",
    """
SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders,
       count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS without_orders FROM customer GROUP BY 1""",
)
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    same = customers["c_custkey"] == orders["o_custkey"]
    both = customers.join(orders, same, "left_semi").select("c_mktsegment", F.lit(1).alias("w"), F.lit(0).alias("o")).unionAll(
        customers.join(orders, same, "left_anti").select("c_mktsegment", F.lit(0), F.lit(1))
    )
    return both.groupBy("c_mktsegment").agg(F.sum("w").alias("with_orders"), F.sum("o").alias("without_orders"))


@query(
    "full_outer_missing",
    """
WITH s AS (SELECT s_nationkey AS k, count(*)::VARCHAR AS n FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*)::VARCHAR AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1)
SELECT k::BIGINT AS nation, coalesce(s.n, 'missing') AS suppliers, coalesce(c.n, 'missing') AS indebted FROM s FULL JOIN c USING (k)""",
)
def full_outer_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, k, n: df.groupBy(F.col(k).alias("nation")).agg(F.count(F.lit(1)).cast("string").alias(n))
    left = count(table(spark, sf_dir, "supplier"), "s_nationkey", "a")
    right = count(table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_nationkey", "b")
    return rounded(relations.outer_with_missing(left, right, "nation", {"suppliers": "a", "indebted": "b"}))


@query(
    "ordered_dedup",
    """
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = relations.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "pick_roles",
    """
WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i,
                  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, 'least' AS role, o_orderkey, o_totalprice FROM r WHERE i = 0
UNION ALL SELECT o_orderpriority, 'middle', o_orderkey, o_totalprice FROM r WHERE i = n // 2
UNION ALL SELECT o_orderpriority, 'greatest', o_orderkey, o_totalprice FROM r WHERE i = n - 1""",
)
def pick_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.roles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey")


@query(
    "adjacent_audit",
    """
SELECT p_brand, p_type, p_partkey, p_size::BIGINT AS p_size, coalesce(lead(p_partkey) OVER w, first_value(p_partkey) OVER w) AS next_item,
       (coalesce(lead(p_size) OVER w, first_value(p_size) OVER w + 60) - p_size)::BIGINT AS gap
FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey)""",
)
def adjacent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relations.neighbours_around(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size", "p_partkey", 60))


@query(
    "json_contract_inventory",
    """
WITH k AS (SELECT event_type, unnest(json_keys(props)) AS path, props FROM events WHERE props IS NOT NULL)
SELECT event_type, path, count(*) AS n, min(json_extract_string(props, '$.' || path)::DOUBLE) AS low, max(json_extract_string(props, '$.' || path)::DOUBLE) AS high,
       count(DISTINCT json_extract_string(props, '$.' || path)) AS "values" FROM k GROUP BY ALL""",
)
def json_contract_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return long.groupBy("event_type", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("value").try_cast("double")).alias("low"),
        F.max(F.col("value").try_cast("double")).alias("high"),
        F.count_distinct("value").alias("values"),
    )


@query(
    "pivot_matrix",
    """
SELECT l_returnflag, round(median(l_quantity) FILTER (l_linestatus = 'F'), 6) + 0.0 AS F, round(median(l_quantity) FILTER (l_linestatus = 'O'), 6) + 0.0 AS O
FROM lineitem GROUP BY 1""",
)
def pivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return rounded(lines.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.median("l_quantity")))


@query(
    "nearest_vector",
    """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY ALL),
d AS (SELECT vec_id, c.label, sum((x - c) * (x - c)) AS d FROM x JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, arg_min(label, struct_pack(d := d, l := label))::BIGINT AS nearest, round(min(d), 5) + 0.0 AS distance FROM d GROUP BY vec_id""",
)
def nearest_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    centres = relations.mean_vectors(vectors, "label", "embedding")
    return rounded(relations.nearest_centre(vectors, "vec_id", "embedding", centres, "label", "centre"), 5)


@query(
    "quality_violations",
    """
SELECT 'o_custkey_unknown' AS code, 'error' AS severity, 'orders/' || o_orderkey AS path, 'o_custkey must exist' AS message FROM orders
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'o_orderkey_repeated', 'error', 'orders/' || o_orderkey, 'o_orderkey must be unique' FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'price_range', 'warning', 'orders/' || o_orderkey, 'o_totalprice must be in range' FROM orders WHERE NOT (o_totalprice BETWEEN 5000 AND 450000)
UNION ALL SELECT 'value_missing', 'error', 'events/' || event_id, 'value is required' FROM events WHERE value IS NULL""",
)
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, events = (table(spark, sf_dir, t) for t in ("orders", "customer", "events"))
    rules = relations.Rules().refers_to(orders, "orders", "o_orderkey", "o_custkey", customers.where("c_acctbal > 0"), "c_custkey")
    rules.unique(orders, "orders", "o_orderkey")
    in_range = F.col("o_totalprice").between(5000, 450000)
    rules.holds(orders, "orders", "o_orderkey", in_range, "price_range", "o_totalprice must be in range", "warning")
    return rules.not_null(events, "events", "event_id", "value").violations()


@query(
    "empirical_ppf",
    """
WITH s AS (SELECT c_mktsegment AS k, list_sort(list(c_acctbal)) AS v, count(*) AS n FROM customer GROUP BY 1), u AS (SELECT unnest(range(0, 20)) AS i)
SELECT k AS c_mktsegment, i, v[least(floor((i + 0.5) / 20 * n), n - 1)::BIGINT + 1] + 0.0 AS value FROM s, u""",
)
def empirical_ppf(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.collect_list("c_acctbal").alias("v"))
    drawn = samples.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    value = distributions.empirical_ppf((F.col("i") + 0.5) / 20, F.col("v"))
    return rounded(drawn.select("c_mktsegment", "i", value.alias("value")))


@query(
    "triangular_ppf",
    """
WITH r AS (SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey)) - 0.5) / (SELECT count(*) FROM part) AS u, 900.0 AS a, 900.0 + p_size AS m, 1000.0 AS b FROM part)
SELECT p_partkey, round(CASE WHEN b = a THEN a WHEN u <= (m - a) / (b - a) THEN a + sqrt(u * (b - a) * (m - a)) ELSE b - sqrt((1 - u) * (b - a) * (b - m)) END, 6) + 0.0 AS value
FROM r""",
)
def triangular_ppf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    parts = table(spark, sf_dir, "part")
    n = F.broadcast(parts.agg(F.count(F.lit(1)).alias("n")))  # one row
    u = (F.row_number().over(Window.orderBy("p_partkey")) - 0.5) / F.col("n")  # a small dimension table
    drawn = parts.join(n).withColumn("u", u)
    low, high = F.lit(900.0), F.lit(1000.0)
    return rounded(drawn.select("p_partkey", distributions.triangular_ppf(F.col("u"), low, 900.0 + F.col("p_size"), high).alias("value")))


@query(
    "unit_conversion",
    """
WITH q AS (SELECT p_partkey, p_size::DOUBLE AS v, ['km/h', 'mph', 'kph', 'in', 'hp', 'rpm', 'deg', 'furlong'][p_partkey % 8 + 1] AS unit FROM part)
SELECT p_partkey, unit, round(v * CASE unit WHEN 'km/h' THEN 1 / 3.6 WHEN 'kph' THEN 1 / 3.6 WHEN 'mph' THEN 0.44704 WHEN 'in' THEN 0.0254 WHEN 'hp' THEN 745.6998715822702
       WHEN 'rpm' THEN 2 * pi() / 60 WHEN 'deg' THEN pi() / 180 END, 6) + 0.0 AS si_value,
       CASE unit WHEN 'km/h' THEN 'speed' WHEN 'kph' THEN 'speed' WHEN 'mph' THEN 'speed' WHEN 'in' THEN 'length' WHEN 'hp' THEN 'power' WHEN 'rpm' THEN 'angular_speed'
       WHEN 'deg' THEN 'angle' END AS dimension FROM q""",
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lapsight.functions.units import with_si

    names = F.array(*[F.lit(u) for u in ("km/h", "mph", "kph", "in", "hp", "rpm", "deg", "furlong")])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("unit"))
    return rounded(with_si(rows, "v", "unit").select("p_partkey", "unit", "si_value", "dimension"))


@query(
    "haversine_steps",
    """
WITH p AS (SELECT c_custkey, c_nationkey, c_acctbal / 1000.0 AS lat, (c_custkey % 180)::DOUBLE AS lon FROM customer),
l AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
h AS (SELECT c_nationkey, sin(radians(lat - a) / 2) ^ 2 + cos(radians(a)) * cos(radians(lat)) * sin(radians(lon - o) / 2) ^ 2 AS q FROM l),
d AS (SELECT c_nationkey, 2 * 6371008.8 * asin(CASE WHEN q > 1 THEN 1 ELSE sqrt(q) END) AS d FROM h)
SELECT c_nationkey::BIGINT AS c_nationkey, count(d) AS steps, round(sum(d) / 1000, 4) + 0.0 AS path_km FROM d GROUP BY 1""",
)
def haversine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from lapsight.functions.geo import haversine_m

    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    points = table(spark, sf_dir, "customer").withColumns({"lat": F.col("c_acctbal") / 1000.0, "lon": (F.col("c_custkey") % 180).cast("double")})
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    out = points.withColumn("d", step).groupBy("c_nationkey").agg(F.count("d").alias("steps"), (F.sum("d") / 1000).alias("path_km"))
    return rounded(out, 4)
