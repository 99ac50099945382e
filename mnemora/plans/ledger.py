"""Queries of tasks, events, cooldowns, sessions, staleness, queues, timelines, and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import fixed, replies, text as tx
from mnemora.operators import activity as ac, queue as qu
from mnemora.plans.corpus import _in
from mnemora.sources.tables import table
from mnemora.streaming import capture

NOW = "1998-12-31"
QUEUE_NOW = "2024-01-31 00:00:00"
STALE_DAYS = {"1-URGENT": 60, "2-HIGH": 90, "3-MEDIUM": 365, "5-LOW": None}


def _events(s, d) -> DataFrame:
    return table(s, d, "events")


def temporal_as_of(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    until = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd")).otherwise("none")
    rows = table(s, d, "orders").select("o_orderkey", day.alias("ts"), until.alias("valid_to"))
    return rows.where(((F.col("ts") == "") | (F.col("ts") <= "1996-06-30")) & (F.col("valid_to").isin("", "null", "none", "~") | (F.col("valid_to") >= "1996-06-30")))


def since_filter(s, d):
    return _events(s, d).where(F.date_format("ts", "yyyy-MM-dd") >= "2024-01-20").select("event_id", "user_id", "event_type")


def task_status_fold(s, d):
    done = table(s, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    folded = ac.fold_tasks(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")
    return folded.groupBy("o_orderstatus", "state").agg(F.count(F.lit(1)).alias("n"))


def task_conflicts(s, d):
    """Open tasks of different agents that share two words: parts of different brands that no returned first line item completes."""
    done = table(s, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    p = ac.fold_tasks(table(s, d, "part"), done, "p_partkey").where("state = 'open'")
    return ac.overlap_pairs(p, "p_partkey", tx.title_words(F.col("p_name"), fixed.TASK_STOP), "p_brand")


def edit_loops(s, d):
    return ac.loops(_events(s, d), [F.col("user_id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd").alias("day")], 3)


def topic_loops(s, d):
    """The ten commonest topics of documents, then those that come three times: the order matters. A topic: the first three words of five letters or more."""
    long = lambda w: w.rlike(r"^\p{L}{5,}$") & ~w.isin(*fixed.TOPIC_STOP)
    words = F.slice(F.filter(tx.tokens(F.col("text")), long), 1, 3)
    sig = F.array_join(F.array_sort(words), " ")
    n = table(s, d, "documents").where(F.size(words) > 0).groupBy(sig.alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "topic").limit(10).where("n >= 3")


def _cool(seconds: float):
    def query(s, d):
        return ac.cooldown(_events(s, d).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.col("ts"), ["event_id"], seconds)

    return query


def session_blocks(s, d):
    return ac.sessions(_events(s, d), "user_id", "ts", 6 * 3600, "event_id")


def conversation_blocks(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.max("turn").alias("last_turn"))


def last_turns(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(s, d, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 3").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


def latest_heartbeat(s, d):
    return ac.latest(_events(s, d), ["user_id"], ["ts", "event_id"], ["event_type"])


def daily_bucket(s, d):
    return _events(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def tier_distribution(s, d):
    n = _events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.select("event_type", "n", F.round(F.col("n") / total, 4).alias("share"), ((total >= 5) & (F.col("n") / total > 0.7)).alias("alert"))


def tier_choice(s, d):
    n = table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", F.when(F.col("n") < 50, "DIRECT").when(F.col("n") < 301, "HYBRID").otherwise("EXTERNAL").alias("tier"))


def stale_by_type(s, d):
    return ac.stale(table(s, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), STALE_DAYS, NOW).select("o_orderkey", "o_orderpriority", "limit_days")


def backlog_bands(s, d):
    age = F.datediff(F.lit(NOW).cast("date"), F.col("o_orderdate").cast("date"))
    band = F.when(age <= 0, "today").when(age <= 3, "recent").when(age <= 14, "fortnight").otherwise("old")
    return table(s, d, "orders").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


KINDS = {"signup": "enqueued", "click": "leased", "view": "released", "error": "failed"}


def _tasks(s, d) -> DataFrame:
    """Users as tasks, their events as what happened to them."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    log = _events(s, d).select(F.col("user_id").alias("id"), F.coalesce(kind, F.lit("noted")).alias("kind"), "ts", F.lit("query").alias("type"))
    return qu.state(log.withColumnRenamed("ts", "at").withColumn("payload", F.lit(None).cast("map<string,string>")))


def queue_fold(s, d):
    """Each task's state from its log."""
    return _tasks(s, d).select("id", "enqueued_at", F.col("attempts").cast("long").alias("attempts"), "last_attempt_at", "leased_at")


def queue_eligible(s, d):
    """The oldest 500 free tasks with their verdict: the order matters, skipped ones use up their places."""
    return qu.turn(_tasks(s, d), QUEUE_NOW, 500).withColumn("verdict", qu.verdict(QUEUE_NOW, 45, 4 * 86400)).select("id", "verdict")


def stale_leases(s, d):
    """Tasks held for longer than a lease lasts."""
    return qu.stale_leases(_tasks(s, d), QUEUE_NOW).select("id", "kind")


def queue_status(s, d):
    return table(s, d, "orders").rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("n_failed")).select(
        F.coalesce("o_orderstatus", F.lit("total")).alias("status"), "n", "n_failed"
    )


def timeline(s, d):
    agent = F.when(F.col("event_type").rlike("(?i)click"), "A").when(F.col("event_type").rlike("(?i)purchase"), "B").otherwise("unknown")
    e = _events(s, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit("event").alias("kind"), F.col("event_id").alias("id"), agent.alias("agent"))
    o = table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit("unknown").alias("agent"))
    return e.unionByName(o)


def last_decision(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("o_orderkey"))


def event_props(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return _events(s, d).groupBy("event_type").agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.sum(k).alias("total"))


def block_ends(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(s, d).select("event_id", F.coalesce(F.lead("event_id").over(w), F.lit(-1)).alias("next_id"))


def spawn_gate(s, d):
    """Purchases at or after 18 h, 900 s apart per user at least."""
    rows = _events(s, d).where((F.col("event_type") == "purchase") & (F.hour("ts") >= 18))
    return ac.cooldown(rows.select("user_id", "event_id", "ts"), ["user_id"], F.col("ts"), ["event_id"], 900)


def inventory(s, d):
    made = None
    for name in ("documents", "pages", "events", "conversations", "embeddings", "labels", "benchmark"):
        one = table(s, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        made = one if made is None else made.unionByName(one)
    return made


def page_upsert(s, d):
    """Updates applied to pages: full outer merge, the update wins, new ids appear."""
    base = table(s, d, "documents").select("doc_id", F.col("n_chars").alias("old"))
    new = table(s, d, "documents").where("doc_id % 5 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1_000_000).otherwise(0)).alias("doc_id"), (F.col("n_chars") + 1).alias("new"))
    return base.join(new, "doc_id", "full").select("doc_id", F.coalesce("new", "old").alias("n_chars"), F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated").alias("action"))


def mark_superseded(s, d):
    """Documents that a later one of the same text replaces. Texts meet by two hashes and their length, 24 bytes each."""
    same = [F.xxhash64("text").alias("h"), F.crc32(F.encode("text", "UTF-8")).alias("c"), F.length("text").alias("n")]
    rows = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", *same)
    newer = rows.groupBy("h", "c", "n").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    return rows.join(newer, ["h", "c", "n"]).where("doc_id < top").select("doc_id", F.col("top").alias("superseded_by"))


def newest_entries(s, d):
    """A bounded map of keys: the fifty newest users by their last event."""
    last = ac.latest(_events(s, d), ["user_id"], ["ts", "event_id"], [])
    return last.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("user_id", "event_id")


def first_per_type(s, d):
    """At most five parts of each brand, by key."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(s, d, "part").withColumn("place", F.row_number().over(w)).where("place <= 5").select("p_brand", "p_partkey", "place")


def manifest_diff(s, d):
    """Ids that only the documents or only the manifest, their labels, have: a rebuild is due if there is any."""
    have, listed = table(s, d, "documents").select(F.col("doc_id").alias("key")).distinct(), table(s, d, "labels").select(F.col("doc_id").alias("key")).distinct()
    gone = have.exceptAll(listed).withColumn("side", F.lit("unlisted"))
    return gone.unionByName(listed.exceptAll(have).withColumn("side", F.lit("missing")))


def active_agents(s, d):
    """Users of each day, counted once."""
    return _events(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("n_users"))


def audit_totals(s, d):
    """Sums of line items by how they ended, in one pass."""
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    return table(s, d, "lineitem").agg(flag("A").alias("verified"), flag("R").alias("failed"), flag("N").alias("pending"), F.count(F.lit(1)).alias("total"))


def reply_tiers(s, d):
    """Replies by tier; text without a token is minor, empty text ok."""
    kind = replies.tier(F.col("text"))["tier"]
    return table(s, d, "conversations").where("role = 'assistant'").groupBy(kind.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def stream_cooldown(s, d):
    return capture.run_once(capture.cooldown_stream(capture.event_stream(s, d), 6 * 3600)).select("user_id", "event_type", "event_id")


def stream_session_window(s, d):
    return capture.run_once(capture.session_windows(capture.event_stream(s, d), "6 hours"))


def stream_day_bucket(s, d):
    return capture.run_once(capture.day_buckets(capture.event_stream(s, d))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_heartbeat(s, d):
    changes = capture.run_once(capture.latest_state(capture.event_stream(s, d)), "update")
    return ac.latest(changes, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


def stream_sliding_window(s, d):
    """Events by type in windows of six hours, a new one every two; the last ones stay open."""
    made = capture.run_once(capture.sliding_counts(capture.event_stream(s, d))).where("event_type is not null")
    return made.select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n")


def stream_claims(s, d):
    """Signups as claims with the purchases of the same user within a day, or none."""
    of = lambda kind, name: capture.event_stream(s, d).where(F.col("event_type").eqNullSafe(kind) | F.col("event_id").isNull()).select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.col("event_id").alias(name), "ts")  # noqa: E731  the marker has a key, or the join would drop it before it moves the watermark
    return capture.run_once(capture.claimed(of("signup", "claim"), of("purchase", "finish"), "user_id", "claim", "finish", "1 day")).where("claim is not null")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
QUERIES |= {"cooldown_60s": _cool(60), "cooldown_1h": _cool(3600), "cooldown_6h": _cool(6 * 3600)}


def _cool_sql(seconds: int, keys: str = "user_id, event_type", where: str = "true") -> str:
    join = " AND ".join(f"e.{k} = r.{k}" for k in keys.split(", "))
    cols = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT {keys}, event_id, epoch(ts) AS tm, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS k FROM events WHERE {where}),
r AS (SELECT {keys}, event_id, k, tm AS last, true AS kept FROM e WHERE k = 1
  UNION ALL SELECT {cols}, e.event_id, e.k, CASE WHEN e.tm - r.last >= {seconds} THEN e.tm ELSE r.last END, e.tm - r.last >= {seconds} FROM r JOIN e ON {join} AND e.k = r.k + 1)
SELECT {keys}, event_id FROM r WHERE kept"""


_FOLD = """WITH g AS (SELECT user_id AS id, min(ts) FILTER (event_type = 'signup') AS enqueued_at, count(*) FILTER (event_type = 'error') AS attempts, max(ts) FILTER (event_type = 'error') AS last_attempt_at,
  max(ts) FILTER (event_type = 'click') AS leased, max(ts) FILTER (event_type IN ('view', 'error')) AS freed FROM events GROUP BY user_id),
f AS (SELECT *, CASE WHEN freed IS NULL OR leased > freed THEN leased END AS leased_at FROM g)"""
_DAY = "strftime(ts, '%Y-%m-%d')"
_LATEST = "SELECT * FROM (SELECT user_id, {0}event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"
ORACLE_SQL = {
    "temporal_as_of": """SELECT * FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ts, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') ELSE 'none' END AS valid_to FROM orders)
WHERE ts <= '1996-06-30' AND (valid_to = 'none' OR valid_to >= '1996-06-30')""",
    "since_filter": f"SELECT event_id, user_id, event_type FROM events WHERE {_DAY} >= '2024-01-20'",
    "task_status_fold": "SELECT o_orderstatus, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'done' ELSE 'open' END AS state, count(*) AS n FROM orders GROUP BY 1, 2",
    "task_conflicts": """WITH w AS (SELECT p_partkey AS id, p_brand AS br, unnest(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: x <> '' AND x NOT IN """ + _in(fixed.TASK_STOP) + """)) AS w FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1))
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.id < y.id WHERE x.br <> y.br GROUP BY 1, 2 HAVING count(*) >= 2""",
    "edit_loops": f"SELECT user_id, event_type, {_DAY} AS day, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "topic_loops": r"""WITH t AS (SELECT list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{L}{5,}') AND x NOT IN """ + _in(fixed.TOPIC_STOP) + """)[1:3] AS w FROM documents)
SELECT * FROM (SELECT array_to_string(list_sort(w), ' ') AS topic, count(*) AS n FROM t WHERE len(w) > 0 GROUP BY 1 ORDER BY n DESC, topic LIMIT 10) WHERE n >= 3""",
    "stream_sliding_window": """WITH w AS (SELECT event_type, ts, unnest(range(0, 3)) AS k, to_timestamp(floor(epoch(ts) / 7200) * 7200)::TIMESTAMP AS began FROM events)
SELECT strftime(began - to_hours(2 * k), '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n FROM w GROUP BY ALL""",
    "stream_claims": """SELECT c.user_id, c.event_id AS claim, p.event_id AS finish FROM events c LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 DAY
WHERE c.event_type = 'signup'""",
    "cooldown_60s": _cool_sql(60), "cooldown_1h": _cool_sql(3600), "cooldown_6h": _cool_sql(6 * 3600), "stream_cooldown": _cool_sql(6 * 3600),
    "spawn_gate": _cool_sql(900, "user_id", "event_type = 'purchase' AND hour(ts) >= 18"),
    "session_blocks": """WITH e AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 21600 THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""",
    "conversation_blocks": "SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "last_turns": "SELECT conv_id, turn, length(text)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3",
    "latest_heartbeat": f"SELECT user_id, ts, event_id, event_type FROM ({_LATEST.format('ts, ')})",
    "daily_bucket": f"SELECT {_DAY} AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "tier_distribution": "SELECT event_type, n, round(n / sum(n) OVER (), 4) AS share, sum(n) OVER () >= 5 AND n / sum(n) OVER () > 0.7 AS alert FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
    "tier_choice": "SELECT source, count(*) AS n, CASE WHEN count(*) < 50 THEN 'DIRECT' WHEN count(*) < 301 THEN 'HYBRID' ELSE 'EXTERNAL' END AS tier FROM documents GROUP BY source",
    "stale_by_type": f"""SELECT o_orderkey, o_orderpriority, limit_days FROM (SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 60 WHEN '2-HIGH' THEN 90 WHEN '3-MEDIUM' THEN 365 WHEN '5-LOW' THEN NULL ELSE 180 END AS limit_days, o_orderdate FROM orders)
WHERE date_diff('day', o_orderdate::DATE, DATE '{NOW}') > limit_days""",
    "backlog_bands": f"SELECT CASE WHEN a <= 0 THEN 'today' WHEN a <= 3 THEN 'recent' WHEN a <= 14 THEN 'fortnight' ELSE 'old' END AS band, count(*) AS n FROM (SELECT date_diff('day', o_orderdate::DATE, DATE '{NOW}') AS a FROM orders) GROUP BY 1",
    "queue_fold": f"{_FOLD} SELECT id, enqueued_at, attempts, last_attempt_at, leased_at FROM f",
    "queue_eligible": f"{_FOLD} SELECT id, CASE WHEN attempts >= 45 OR epoch(TIMESTAMP '{QUEUE_NOW}') - epoch(last_attempt_at) < 345600 THEN 'skip' ELSE 'take' END AS verdict FROM (SELECT * FROM f WHERE leased_at IS NULL ORDER BY id LIMIT 500)",
    "stale_leases": f"{_FOLD} SELECT id, 'released' AS kind FROM f WHERE leased_at IS NOT NULL AND epoch(TIMESTAMP '{QUEUE_NOW}') - epoch(leased_at) > 600",
    "stream_session_window": """WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
    "queue_status": "SELECT coalesce(o_orderstatus, 'total') AS status, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS n_failed FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "timeline": """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, 'event' AS kind, event_id AS id, CASE WHEN regexp_matches(event_type, '(?i)click') THEN 'A' WHEN regexp_matches(event_type, '(?i)purchase') THEN 'B' ELSE 'unknown' END AS agent FROM events
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'order', o_orderkey, 'unknown' FROM orders""",
    "last_decision": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "event_props": "SELECT event_type, min(k) AS lo, max(k) AS hi, sum(k)::BIGINT AS total FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1",
    "block_ends": "SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS next_id FROM events",
    "inventory": " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) AS n FROM {n}" for n in ("documents", "pages", "events", "conversations", "embeddings", "labels", "benchmark")),
    "page_upsert": """WITH n AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000 ELSE 0 END AS doc_id, n_chars + 1 AS new FROM documents WHERE doc_id % 5 = 0)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(new, n_chars) AS n_chars, CASE WHEN b.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM documents b FULL JOIN n ON b.doc_id = n.doc_id""",
    "mark_superseded": "SELECT * FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS superseded_by FROM documents WHERE text IS NOT NULL) WHERE doc_id < superseded_by",
    "newest_entries": f"SELECT user_id, event_id FROM (SELECT *, ts FROM ({_LATEST.format('ts, ')}) ORDER BY ts DESC, event_id DESC LIMIT 50)",
    "first_per_type": "SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part) WHERE place <= 5",
    "manifest_diff": """SELECT doc_id AS key, 'unlisted' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "active_agents": f"SELECT {_DAY} AS day, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "audit_totals": "SELECT count(*) FILTER (l_returnflag = 'A') AS verified, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'N') AS pending, count(*) AS total FROM lineitem",
    "reply_tiers": """SELECT CASE WHEN t = '' OR starts_with(t, '(summary failed') OR starts_with(t, '{"operations"') OR starts_with(t, '{"audit"') THEN 'ok' ELSE 'minor' END AS tier, count(*) AS n
FROM (SELECT trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations WHERE role = 'assistant') GROUP BY 1""",
    "stream_day_bucket": f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_heartbeat": f"SELECT user_id, event_id, event_type FROM ({_LATEST.format('')})",
}
