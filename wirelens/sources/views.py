"""Domain inputs (packets, flow records, alerts, ...) as views over the benchmark tables.

Each view exists twice: as a Spark DataFrame here and as SQL in ``SQL`` for the checks.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wirelens.functions.time import micros
from wirelens.session import ship_package, use_utc

AS_OF = datetime(2024, 1, 31)

# rules over documentation addresses: one with all keys, two that overlap, one that an earlier one always beats
ALLOW_RULES = [
    {"name": "backup-login", "src_ip": "10.1.3.19", "dst_ip": "198.51.100.7", "src_port": 1043, "dst_port": 22, "proto": "TCP"},
    {"name": "resolver", "dst_ip": "198.51.100.8", "dst_port": 53, "proto": "UDP"},
    {"name": "name-lookups", "dst_port": 53, "proto": "UDP"},
    {"name": "branch-web", "src_ip": "10.1.5.5", "dst_port": 443},
    {"name": "document-host", "dst_ip": "203.0.113.9"},
    {"name": "document-host-web", "dst_ip": "203.0.113.9", "dst_port": 80},
    {"name": "metrics", "dst_ip": "198.51.100.7", "dst_port": 9100},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(use_utc(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, with event times as instants so that they can carry a watermark."""
    batch = table(spark, sf_dir, name)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in batch.columns else stream


def _k():
    return F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k")


def packets(spark, sf_dir, read=table) -> DataFrame:
    e = read(spark, sf_dir, "events")
    user = F.col("user_id")
    reply = F.col("event_id") % 3 == 2
    client = F.concat(F.lit("10.0."), F.floor(user / 250).cast("string"), F.lit("."), (user % 250).cast("string"))
    server = F.lit("198.51.100.7")
    service = (F.when(user % 6 == 0, 22).when(user % 6 == 1, 53).when(user % 6 == 2, 80)
               .when(user % 6 == 3, 443).when(user % 6 == 4, 1514).otherwise(3478))
    cport = (user + 1024).cast("int")
    udp = (user % 6).isin(1, 5)
    return e.select(
        F.col("event_id").alias("pkt_id"), "ts",
        F.when(reply, server).otherwise(client).alias("src"), F.when(reply, client).otherwise(server).alias("dst"),
        F.when(reply, service).otherwise(cport).alias("sport"), F.when(reply, cport).otherwise(service).alias("dport"),
        F.when(udp, 17).otherwise(6).alias("proto"),
        (F.floor(F.col("value") * 3).cast("int") + 40).alias("size"),
        F.when(udp, 0).otherwise((F.col("event_id") % 256).cast("int")).alias("flags"))


def eve_flow(spark, sf_dir) -> DataFrame:
    """Flow records in the flat form of ``operators.flow_records``."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")

    def side(status, column):
        return F.sum(F.when(F.col("l_linestatus") == status, F.floor(column).cast("long")).otherwise(0))
    measures = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        side("O", "l_quantity").alias("pkts_toserver"), side("F", "l_quantity").alias("pkts_toclient"),
        side("O", "l_extendedprice").alias("bytes_toserver"), side("F", "l_extendedprice").alias("bytes_toclient"),
        micros(F.min("l_shipdate")).alias("start_us"), micros(F.max("l_shipdate")).alias("end_us"),
        F.count("*").alias("age"))
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    port = (F.when(key % 7 == 0, 22).when(key % 7 == 1, 53).when(key % 7 == 2, 80).when(key % 7 == 3, 443)
            .when(key % 7 == 4, 1514).when(key % 7 == 5, 3478).otherwise(9100))
    return orders.join(measures, "o_orderkey").select(
        key.alias("flow_id"),
        F.concat(F.lit("10.1."), (cust % 16).cast("string"), F.lit("."), (cust % 250).cast("string")).alias("src_ip"),
        F.when(cust % 5 == 0, "198.51.100.7").when(cust % 5 == 1, "198.51.100.8")
        .when(cust % 5 == 2, "169.254.169.254")
        .otherwise(F.concat(F.lit("203.0.113."), (key % 50).cast("string"))).alias("dst_ip"),
        (cust + 1024).cast("int").alias("src_port"), port.alias("dst_port"),
        F.when((key % 7).isin(1, 5), "UDP").otherwise("TCP").alias("proto"),
        F.col("o_orderdate").alias("ts"),
        "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "start_us", "end_us", "age")


def ids_alerts(spark, sf_dir, read=table) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", _k())
    k = F.col("k")
    text = k.cast("string")
    family = F.when(k % 4 == 0, "HUNTING").when(k % 4 == 1, "INFO").when(k % 4 == 2, "SCAN").otherwise("POLICY")
    return e.select(
        "event_id", "ts", "k",
        F.when(k < 5, 2016149).when(k < 10, 2210020).otherwise(k + 2024000).cast("long").alias("sid"),
        (k % 3 + 1).alias("severity"),
        F.when(k.between(5, 9), F.concat(F.lit("SURICATA STREAM pkt "), text))
        .otherwise(F.concat(F.lit("ET "), family, F.lit(" rule "), text)).alias("signature"),
        F.concat(F.lit("category "), (k % 5).cast("string")).alias("category"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("src_ip"),
        F.concat(F.lit("203.0.113."), (F.col("event_id") % 5).cast("string")).alias("dest_ip"))


def hids(spark, sf_dir, read=table) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", _k())
    k = F.col("k")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), "ts", (k % 17).alias("level"),
        (k % 20 + 500).cast("string").alias("rule_id"),
        F.concat(F.lit("rule text "), (k % 20).cast("string")).alias("description"),
        F.concat(F.lit("pi"), (F.col("user_id") % 3).cast("string")).alias("agent"),
        F.concat(F.lit("Rule\tcheck   k="), k.cast("string"), F.lit("\nTYPE  "), "event_type").alias("full_log"),
        F.when(k % 4 == 0, "SEVERITY: [High]\nACTION: escalate now").when(k % 4 == 1, "SEVERITY: noise\nACTION: log")
        .when(k % 4 == 2, "no verdict").alias("model_text"), "k")


def lessons(spark, sf_dir) -> DataFrame:
    """A learned store in flat form: ord, rule_id, agent, log_keywords, verdict and counters."""
    h = hids(spark, sf_dir).where((F.col("rule_id").cast("int") < 512) & (F.col("agent") != "pi2"))
    kw = F.lower(F.concat(F.lit("type "), F.element_at(F.split("full_log", "TYPE  "), 2)))
    seen = h.groupBy("rule_id", "agent", kw.alias("kw")).agg(F.max("ts").alias("last_seen"))
    rule = F.col("rule_id").cast("int")
    return seen.select(
        F.row_number().over(Window.orderBy("rule_id", "agent", "kw")).cast("long").alias("ord"),
        "rule_id", "agent", F.array(F.col("kw"), F.lit("rule check")).alias("log_keywords"),
        F.when(rule % 2 == 0, "noise").otherwise("low").alias("severity"),
        F.when(rule % 2 == 0, "ignore").otherwise("log").alias("action"),
        F.when(rule % 3 == 0, "pending").otherwise("authoritative").alias("status"),
        (rule % 5).cast("long").alias("promotion_count"), F.lit(3).cast("long").alias("promotion_threshold"),
        (rule % 4).cast("long").alias("hits"), "last_seen")


def labelled(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.floor("l_extendedprice").cast("long")).alias("row_id"),
        F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_quantity").alias("f0"),
        F.when(key % 97 == 0, float("inf")).when(key % 89 == 0, None)
        .otherwise(F.col("l_extendedprice")).alias("f1"),
        F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"))


def predictions(spark, sf_dir, read=table) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", "value", _k())
    k = F.col("k")
    return e.select(
        "event_id", "ts",
        F.when(k % 7 == 0, "DoS").when(k % 11 == 0, "PortScan").otherwise("BENIGN").alias("prediction"),
        ((k % 100).cast("double") / 100).alias("confidence"), (F.col("value") / 1000).alias("latency_s"),
        F.when(k == 50, 500).otherwise(200).alias("status"))


LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, float("inf")]


def latency_samples(spark, sf_dir) -> DataFrame:
    """Latency buckets as three instances expose them once an hour; an instance begins at zero every 40 hours."""
    hour, instance = F.floor(micros(F.col("ts")) / 3_600_000_000).cast("long"), F.col("event_id") % 3
    counts = predictions(spark, sf_dir).groupBy(instance.alias("instance"), hour.alias("hour")).agg(
        *[F.count_if(F.col("latency_s") <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(LATENCY_BOUNDS)]))
    each = counts.select("instance", "hour", F.floor((F.col("hour") + 7 * F.col("instance")) / 40).alias("start"), each.alias("x"))
    running = Window.partitionBy("instance", "start", "x.le").orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("instance", F.col("x.le").alias("le"), (F.col("hour") * 3_600_000_000 + 1_800_000_000).alias("us"),
                       F.sum("x.n").over(running).alias("value"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


# ---------------------------------------------------------------------------
# the same views for the SQL check

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k"

SQL = {
    "v_packets": """
 SELECT event_id AS pkt_id, ts, CASE WHEN rev THEN sip ELSE cip END AS src, CASE WHEN rev THEN cip ELSE sip END AS dst,
  CASE WHEN rev THEN svc ELSE cport END AS sport, CASE WHEN rev THEN cport ELSE svc END AS dport,
  CASE WHEN user_id % 6 IN (1, 5) THEN 17 ELSE 6 END AS proto, 40 + CAST(floor(value * 3) AS INT) AS size,
  CASE WHEN user_id % 6 IN (1, 5) THEN 0 ELSE CAST(event_id % 256 AS INT) END AS flags
 FROM (SELECT event_id, ts, user_id, value, event_id % 3 = 2 AS rev,
   '10.0.' || CAST(CAST(floor(user_id / 250) AS INT) AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS cip,
   '198.51.100.7' AS sip, CAST(1024 + user_id AS INT) AS cport,
   CASE user_id % 6 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 1514 ELSE 3478 END AS svc
  FROM events) b""",
    "v_eve_flow": """
 SELECT o_orderkey AS flow_id,
  '10.1.' || CAST(o_custkey % 16 AS VARCHAR) || '.' || CAST(o_custkey % 250 AS VARCHAR) AS src_ip,
  CASE o_custkey % 5 WHEN 0 THEN '198.51.100.7' WHEN 1 THEN '198.51.100.8' WHEN 2 THEN '169.254.169.254'
   ELSE '203.0.113.' || CAST(o_orderkey % 50 AS VARCHAR) END AS dst_ip,
  CAST(1024 + o_custkey AS INT) AS src_port,
  CASE o_orderkey % 7 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 1514
   WHEN 5 THEN 3478 ELSE 9100 END AS dst_port,
  CASE WHEN o_orderkey % 7 IN (1, 5) THEN 'UDP' ELSE 'TCP' END AS proto, o_orderdate AS ts, p.* EXCLUDE (l_orderkey)
 FROM orders JOIN (SELECT l_orderkey,
   CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS pkts_toserver,
   CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS pkts_toclient,
   CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes_toserver,
   CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes_toclient,
   epoch_us(min(l_shipdate)) AS start_us, epoch_us(max(l_shipdate)) AS end_us, count(*) AS age
  FROM lineitem GROUP BY 1) p ON l_orderkey = o_orderkey""",
    "v_ids_alerts": f"""
 SELECT event_id, ts, k,
  CAST(CASE WHEN k < 5 THEN 2016149 WHEN k < 10 THEN 2210020 ELSE 2024000 + k END AS BIGINT) AS sid, 1 + k % 3 AS severity,
  CASE WHEN k BETWEEN 5 AND 9 THEN 'SURICATA STREAM pkt ' || k
   ELSE 'ET ' || (CASE k % 4 WHEN 0 THEN 'HUNTING' WHEN 1 THEN 'INFO' WHEN 2 THEN 'SCAN' ELSE 'POLICY' END) || ' rule ' || k
   END AS signature,
  'category ' || (k % 5) AS category, '10.0.0.' || (user_id % 16) AS src_ip, '203.0.113.' || (event_id % 5) AS dest_ip
 FROM (SELECT *, {_K} FROM events)""",
    "v_hids": f"""
 SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts, k % 17 AS level, CAST(500 + k % 20 AS VARCHAR) AS rule_id,
  'rule text ' || (k % 20) AS description, 'pi' || (user_id % 3) AS agent,
  'Rule' || chr(9) || 'check   k=' || k || chr(10) || 'TYPE  ' || event_type AS full_log,
  CASE k % 4 WHEN 0 THEN 'SEVERITY: [High]' || chr(10) || 'ACTION: escalate now'
   WHEN 1 THEN 'SEVERITY: noise' || chr(10) || 'ACTION: log' WHEN 2 THEN 'no verdict' ELSE NULL END AS model_text, k
 FROM (SELECT *, {_K} FROM events)""",
    "v_lessons": """
 SELECT row_number() OVER (ORDER BY rule_id, agent, kw) AS ord, rule_id, agent, [kw, 'rule check'] AS log_keywords,
  CASE WHEN CAST(rule_id AS INT) % 2 = 0 THEN 'noise' ELSE 'low' END AS severity,
  CASE WHEN CAST(rule_id AS INT) % 2 = 0 THEN 'ignore' ELSE 'log' END AS action,
  CASE WHEN CAST(rule_id AS INT) % 3 = 0 THEN 'pending' ELSE 'authoritative' END AS status,
  CAST(CAST(rule_id AS INT) % 5 AS BIGINT) AS promotion_count, CAST(3 AS BIGINT) AS promotion_threshold,
  CAST(CAST(rule_id AS INT) % 4 AS BIGINT) AS hits, last_seen
 FROM (SELECT rule_id, agent, lower('type ' || split_part(full_log, 'TYPE  ', 2)) AS kw, max(ts) AS last_seen
       FROM v_hids WHERE CAST(rule_id AS INT) < 512 AND agent <> 'pi2' GROUP BY 1, 2, 3)""",
    "v_labelled": """
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS row_id,
  l_returnflag || l_linestatus AS label, l_quantity AS f0,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_extendedprice END AS f1,
  l_discount AS f2, l_tax AS f3 FROM lineitem""",
    "v_predictions": f"""
 SELECT event_id, ts, CASE WHEN k % 7 = 0 THEN 'DoS' WHEN k % 11 = 0 THEN 'PortScan' ELSE 'BENIGN' END AS prediction,
  CAST(k % 100 AS DOUBLE) / 100 AS confidence, value / 1000 AS latency_s, CASE WHEN k = 50 THEN 500 ELSE 200 END AS status
 FROM (SELECT *, {_K} FROM events)""",
    "v_latency_samples": """
 SELECT instance, le, h * 3600000000 + 1800000000 AS us,
  sum(n) OVER (PARTITION BY instance, le, (h + 7 * instance) // 40 ORDER BY h) AS value
 FROM (SELECT event_id % 3 AS instance, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h, le,
        count(*) FILTER (latency_s <= le) AS n
       FROM v_predictions, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, CAST('inf' AS DOUBLE)]) AS le) GROUP BY 1, 2, 3)""",
    "v_vectors": "\n SELECT vec_id, embedding, label FROM embeddings",
}

_NEEDS = {"v_lessons": ["v_hids"], "v_latency_samples": ["v_predictions"]}


def with_views(views: list[str], ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    """One SQL string: the views, then further named steps, then the final select."""
    names = []
    for view in views:
        names += [n for n in [*_NEEDS.get(view, []), view] if n not in names]
    steps = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes.items()]
    if not steps:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(steps) + "\n" + body
