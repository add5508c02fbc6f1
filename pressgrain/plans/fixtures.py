"""The given tables seen as news tables: pure projections, each with its SQL twin.

``Tables`` builds the Spark side; ``VIEWS`` holds the same projection as DuckDB SQL so that an
oracle query starts from exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


NOW = "2024-01-20 00:00:00"

VIEWS: dict[str, str] = {
    "fx_active": f"SELECT * FROM fx_contents WHERE status = 'active' AND analysis_allowed AND expires_at > TIMESTAMP '{NOW}'",
    # the digest of a URL set, slice by slice
    "fx_url_sets": """SELECT issue_id, sum(c) AS set_size, sha256(string_agg(d, chr(10) ORDER BY slot)) AS set_digest
        FROM (SELECT issue_id, substr(sha256(canonical_url), 1, 3) AS slot, count(*) AS c, sha256(string_agg(canonical_url, chr(10) ORDER BY canonical_url)) AS d
              FROM (SELECT DISTINCT issue_id, canonical_url FROM fx_reviewed WHERE canonical_url IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""",
    "fx_signals": "SELECT doc_id AS article_id FROM labels WHERE toxic = 0",
}


def _view(name: str, sql: str):
    VIEWS[name] = sql

    def wrap(fn):
        return property(fn)

    return wrap


def ntz(text: str):
    """Zone-free timestamp literal; the fixtures never depend on the session time zone."""
    return F.lit(text).cast("timestamp_ntz")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @_view("fx_articles", r"""
        SELECT doc_id AS article_id, source AS source_id,
               'group' || CAST(CAST(substr(source, 4) AS BIGINT) // 2 AS VARCHAR) AS media_group_id,
               'https://news.example.com/a/' || doc_id AS canonical_url,
               split_part(text, chr(10), 1) AS title, lang AS section,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER))
                 + to_hours(CAST(doc_id % 24 AS INTEGER)) AS published_at,
               TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(doc_id % 31 AS INTEGER)) AS collected_at,
               CASE doc_id % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'main' WHEN 2 THEN 'list' END AS homepage_placement,
               text AS body_text FROM documents""")
    def articles(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            F.col("doc_id").alias("article_id"),
            F.col("source").alias("source_id"),
            F.concat(F.lit("group"), F.expr("cast(substr(source, 4) as bigint) div 2").cast("string")).alias("media_group_id"),
            F.concat(F.lit("https://news.example.com/a/"), F.col("doc_id")).alias("canonical_url"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("lang").alias("section"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int), cast(doc_id % 24 as int))").alias("published_at"),
            F.expr("timestamp_ntz'2024-01-01 06:00:00' + make_dt_interval(cast(doc_id % 31 as int))").alias("collected_at"),
            F.expr("case doc_id % 5 when 0 then 'top' when 1 then 'main' when 2 then 'list' end").alias("homepage_placement"),
            F.col("text").alias("body_text"),
        )

    @_view("fx_panel", """
        SELECT source_id, CASE WHEN n % 3 = 0 THEN 'broadcast' ELSE 'daily' END AS source_type,
               'group' || CAST(n // 2 AS VARCHAR) AS media_group_id, n % 7 <> 6 AS active,
               'Outlet ' || n AS source_name,
               CASE n % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'metadata' ELSE 'licensed' END AS rights_level
        FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS BIGINT) AS n FROM documents)""")
    def panel(self) -> DataFrame:
        d = self.raw("documents").select(F.col("source").alias("source_id")).distinct()
        d = d.withColumn("n", F.expr("cast(substr(source_id, 4) as bigint)"))
        return d.select(
            "source_id",
            F.expr("case when n % 3 = 0 then 'broadcast' else 'daily' end").alias("source_type"),
            F.expr("concat('group', n div 2)").alias("media_group_id"),
            F.expr("n % 7 <> 6").alias("active"),
            F.expr("concat('Outlet ', n)").alias("source_name"),
            F.expr("case n % 3 when 0 then 'full' when 1 then 'metadata' else 'licensed' end").alias("rights_level"),
        )

    @_view("fx_placements", """
        SELECT event_id AS observation_id, user_id AS article_id,
               'https://news.example.com/a/' || user_id AS url,
               CASE event_type WHEN 'click' THEN 'top' WHEN 'view' THEN 'main' WHEN 'purchase' THEN 'section' ELSE 'list' END AS zone,
               ts AS observed_at, CAST(event_id % 50 + 1 AS BIGINT) AS page_rank FROM events""")
    def placements(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("observation_id"),
            F.col("user_id").alias("article_id"),
            F.concat(F.lit("https://news.example.com/a/"), F.col("user_id")).alias("url"),
            F.expr("case event_type when 'click' then 'top' when 'view' then 'main' when 'purchase' then 'section' else 'list' end").alias("zone"),
            F.col("ts").alias("observed_at"),
            F.expr("event_id % 50 + 1").alias("page_rank"),
        )

    @_view("fx_runs", """
        SELECT o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS target_date,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS started_at,
               o_orderdate + to_minutes(CAST(o_orderkey % 1440 + o_custkey % 60 AS INTEGER)) AS finished_at,
               'src' || CAST(o_custkey % 20 AS VARCHAR) AS source_id FROM orders""")
    def runs(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("run_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("target_date"),
            F.expr("case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'failed' end").alias("status"),
            F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int))").alias("started_at"),
            F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 + o_custkey % 60 as int))").alias("finished_at"),
            F.expr("concat('src', o_custkey % 20)").alias("source_id"),
        )

    @_view("fx_lines", """
        SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity,
               max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax,
               max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_shipdate) AS l_shipdate
        FROM lineitem GROUP BY l_orderkey, l_linenumber""")
    def lines(self) -> DataFrame:
        """One row per (order, line): the given table repeats some of these keys."""
        names = ("partkey", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")
        return self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(f"l_{n}").alias(f"l_{n}") for n in names])

    @_view("fx_issues", """
        SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_orderkey AS run_id,
               CASE l_returnflag WHEN 'A' THEN 'economy' WHEN 'N' THEN 'politics' ELSE 'sports' END AS category,
               floor(l_extendedprice / 1000 * 10) / 10 AS agenda_score,
               CAST(l_quantity AS BIGINT) AS article_count, CAST(l_quantity AS BIGINT) % 7 + 1 AS source_count,
               floor(l_discount * 1000) / 10 AS cohesion_score,
               'Issue ' || l_partkey AS title,
               CASE WHEN l_tax < 0.03 THEN 'cohesive' WHEN l_tax < 0.06 THEN 'review_required' ELSE 'insufficient_evidence' END AS cluster_quality
        FROM fx_lines""")
    def issues(self) -> DataFrame:
        li = self.lines
        return li.select(
            F.expr("l_orderkey * 10 + l_linenumber").alias("issue_id"),
            F.col("l_orderkey").alias("run_id"),
            F.expr("case l_returnflag when 'A' then 'economy' when 'N' then 'politics' else 'sports' end").alias("category"),
            F.expr("floor(l_extendedprice / 1000 * 10) / 10").alias("agenda_score"),
            F.col("l_quantity").cast("bigint").alias("article_count"),
            F.expr("cast(l_quantity as bigint) % 7 + 1").alias("source_count"),
            F.expr("floor(l_discount * 1000) / 10").alias("cohesion_score"),
            F.expr("concat('Issue ', l_partkey)").alias("title"),
            F.expr("case when l_tax < 0.03D then 'cohesive' when l_tax < 0.06D then 'review_required' else 'insufficient_evidence' end").alias("cluster_quality"),
        )

    @_view("fx_members", """
        SELECT doc_id // 25 AS issue_id, doc_id AS article_id, source AS source_id,
               'group' || CAST(CAST(substr(source, 4) AS BIGINT) // 2 AS VARCHAR) AS media_group_id,
               doc_id % 25 = 3 AS is_representative, (n_chars % 100) / 100 AS similarity FROM documents""")
    def members(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            F.expr("doc_id div 25").alias("issue_id"),
            F.col("doc_id").alias("article_id"),
            F.col("source").alias("source_id"),
            F.expr("concat('group', cast(substr(source, 4) as bigint) div 2)").alias("media_group_id"),
            F.expr("doc_id % 25 = 3").alias("is_representative"),
            F.expr("(n_chars % 100) / 100").alias("similarity"),
        )

    @_view("fx_contents", """
        SELECT doc_id AS content_id, doc_id - doc_id % 3 AS article_id, sha256(text) AS body_sha256,
               CAST(length(text) AS BIGINT) AS body_chars, text AS body_text,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 13 AS INTEGER)) AS acquired_at,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 13 + doc_id % 45 AS INTEGER)) AS expires_at,
               CASE WHEN doc_id % 5 = 0 THEN 'purged' ELSE 'active' END AS status,
               doc_id % 4 <> 1 AS analysis_allowed, source AS source_id FROM documents""")
    def contents(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            F.col("doc_id").alias("content_id"),
            F.expr("doc_id - doc_id % 3").alias("article_id"),
            F.sha2("text", 256).alias("body_sha256"),
            F.length("text").cast("bigint").alias("body_chars"),
            F.col("text").alias("body_text"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 13 as int))").alias("acquired_at"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 13 + doc_id % 45 as int))").alias("expires_at"),
            F.expr("case when doc_id % 5 = 0 then 'purged' else 'active' end").alias("status"),
            F.expr("doc_id % 4 <> 1").alias("analysis_allowed"),
            F.col("source").alias("source_id"),
        )

    @_view("fx_profiles", """
        SELECT doc_id * 10 + v AS profile_id, doc_id - doc_id % 3 AS article_id, 'v' || CAST(v AS VARCHAR) AS extractor_version,
               CASE WHEN toxic = 1 THEN 'human' ELSE 'rules' END AS provider, '1' AS schema_version,
               CASE WHEN (doc_id + v) % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id * 7 % 500 + v AS INTEGER)) AS analyzed_at,
               CAST(quality AS BIGINT) AS quality
        FROM labels, (VALUES (1), (2)) versions(v)""")
    def profiles(self) -> DataFrame:
        p = self.raw("labels").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
        return p.select(
            F.expr("doc_id * 10 + v").alias("profile_id"),
            F.expr("doc_id - doc_id % 3").alias("article_id"),
            F.concat(F.lit("v"), F.col("v")).alias("extractor_version"),
            F.expr("case when toxic = 1 then 'human' else 'rules' end").alias("provider"),
            F.lit("1").alias("schema_version"),
            F.expr("case when (doc_id + v) % 3 = 0 then 'failed' else 'succeeded' end").alias("status"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id * 7 % 500 + v as int))").alias("analyzed_at"),
            F.col("quality").cast("bigint").alias("quality"),
        )

    @_view("fx_states", """
        SELECT event_id AS seq, user_id AS item_id, ts AS updated_at,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'retry_wait'
                    WHEN 'purchase' THEN 'succeeded' ELSE 'dead_letter' END AS state FROM events""")
    def states(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("item_id"),
            F.col("ts").alias("updated_at"),
            F.expr("case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'retry_wait' when 'purchase' then 'succeeded' else 'dead_letter' end").alias("state"),
        )

    @_view("fx_attempts", """
        SELECT user_id * 3 AS article_id, event_id AS attempt_id, ts AS attempted_at,
               CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'ok' END AS outcome,
               event_id % 6 + 1 AS attempt_count FROM events""")
    def attempts(self) -> DataFrame:
        return self.raw("events").select(
            F.expr("user_id * 3").alias("article_id"),
            F.col("event_id").alias("attempt_id"),
            F.col("ts").alias("attempted_at"),
            F.expr("case when event_type in ('error', 'view') then 'failed' else 'ok' end").alias("outcome"),
            F.expr("event_id % 6 + 1").alias("attempt_count"),
        )

    @_view("fx_jobs", """
        SELECT o_orderkey AS job_id, 'queue' || CAST(o_custkey % 4 AS VARCHAR) AS queue,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'retry_wait' END AS status,
               o_custkey % 6 AS attempts, CAST(5 AS BIGINT) AS max_attempts,
               o_orderdate AS due_at, o_orderdate - to_days(CAST(o_orderkey % 5 AS INTEGER)) AS created_at FROM orders""")
    def jobs(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("job_id"),
            F.expr("concat('queue', o_custkey % 4)").alias("queue"),
            F.expr("cast(substr(o_orderpriority, 1, 1) as bigint)").alias("priority"),
            F.expr("case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'retry_wait' end").alias("status"),
            F.expr("o_custkey % 6").alias("attempts"),
            F.lit(5).cast("bigint").alias("max_attempts"),
            F.col("o_orderdate").alias("due_at"),
            F.expr("o_orderdate - make_dt_interval(cast(o_orderkey % 5 as int))").alias("created_at"),
        )

    @_view("fx_dead_letters", """
        SELECT o_orderkey + 1000000 AS dead_letter_id, o_orderkey AS job_id, o_orderdate AS failed_at,
               CASE WHEN o_custkey % 3 = 0 THEN o_orderdate + to_days(1) END AS redriven_at
        FROM orders WHERE o_orderstatus = 'P'""")
    def dead_letters(self) -> DataFrame:
        return self.raw("orders").filter("o_orderstatus = 'P'").select(
            F.expr("o_orderkey + 1000000").alias("dead_letter_id"),
            F.col("o_orderkey").alias("job_id"),
            F.col("o_orderdate").alias("failed_at"),
            F.expr("case when o_custkey % 3 = 0 then o_orderdate + make_dt_interval(1) end").alias("redriven_at"),
        )

    @_view("fx_outbox", """
        SELECT l_orderkey * 10 + l_linenumber AS event_id, 'dest' || l_returnflag AS destination,
               l_partkey || ':' || l_suppkey || ':' || l_orderkey AS idempotency_key,
               CASE WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'pending' END AS status,
               CAST(l_quantity AS BIGINT) AS payload_version, l_shipdate AS delivered_at FROM fx_lines""")
    def outbox(self) -> DataFrame:
        return self.lines.select(
            F.expr("l_orderkey * 10 + l_linenumber").alias("event_id"),
            F.expr("concat('dest', l_returnflag)").alias("destination"),
            F.expr("concat(l_partkey, ':', l_suppkey, ':', l_orderkey)").alias("idempotency_key"),
            F.expr("case when l_linestatus = 'F' then 'delivered' else 'pending' end").alias("status"),
            F.col("l_quantity").cast("bigint").alias("payload_version"),
            F.col("l_shipdate").alias("delivered_at"),
        )

    @_view("fx_receipts", """
        SELECT l_orderkey * 10 + l_linenumber + 5000000000 AS receipt_id,
               l_orderkey * 10 + l_linenumber + CASE WHEN l_linenumber % 2 = 0 THEN 7000000000 ELSE 0 END AS event_id,
               'dest' || CASE WHEN l_linenumber = 3 THEN 'X' ELSE l_returnflag END AS destination,
               l_partkey || ':' || l_suppkey || ':' || l_orderkey AS idempotency_key,
               CAST(l_quantity AS BIGINT) + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS payload_version
        FROM fx_lines WHERE l_quantity > 20""")
    def receipts(self) -> DataFrame:
        return self.lines.filter("l_quantity > 20").select(
            F.expr("l_orderkey * 10 + l_linenumber + 5000000000").alias("receipt_id"),
            F.expr("l_orderkey * 10 + l_linenumber + case when l_linenumber % 2 = 0 then 7000000000 else 0 end").alias("event_id"),
            F.expr("concat('dest', case when l_linenumber = 3 then 'X' else l_returnflag end)").alias("destination"),
            F.expr("concat(l_partkey, ':', l_suppkey, ':', l_orderkey)").alias("idempotency_key"),
            F.expr("cast(l_quantity as bigint) + case when l_tax > 0.06D then 1 else 0 end").alias("payload_version"),
        )

    @_view("fx_posts", """
        SELECT conv_id AS post_id, role AS author_kind, text AS body, conv_id * 3 AS issue_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 400 AS INTEGER)) AS created_at
        FROM conversations WHERE turn = 0""")
    def posts(self) -> DataFrame:
        return self.raw("conversations").filter("turn = 0").select(
            F.col("conv_id").alias("post_id"),
            F.col("role").alias("author_kind"),
            F.col("text").alias("body"),
            F.expr("conv_id * 3").alias("issue_id"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 400 as int))").alias("created_at"),
        )

    @_view("fx_replies", """
        SELECT conv_id AS post_id, conv_id * 100 + turn AS reply_id, role AS author_kind, text AS body,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 400 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at
        FROM conversations WHERE turn > 0""")
    def replies(self) -> DataFrame:
        return self.raw("conversations").filter("turn > 0").select(
            F.col("conv_id").alias("post_id"),
            F.expr("conv_id * 100 + turn").alias("reply_id"),
            F.col("role").alias("author_kind"),
            F.col("text").alias("body"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 400 as int), cast(turn as int))").alias("created_at"),
        )

    @_view("fx_reactions", """
        SELECT user_id AS post_id, event_id % 97 AS actor_id, ts AS reacted_at FROM events WHERE event_type IN ('click', 'purchase')""")
    def reactions(self) -> DataFrame:
        return self.raw("events").filter("event_type in ('click', 'purchase')").select(
            F.col("user_id").alias("post_id"), F.expr("event_id % 97").alias("actor_id"), F.col("ts").alias("reacted_at"))

    @_view("fx_reports", """
        SELECT user_id AS post_id, event_id % 5 AS reporter_id FROM events WHERE event_type = 'error' AND event_id % 4 = 0""")
    def reports(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'error' and event_id % 4 = 0").select(
            F.col("user_id").alias("post_id"), F.expr("event_id % 5").alias("reporter_id"))

    @_view("fx_reviews", """
        SELECT doc_id AS review_id, doc_id // 25 AS issue_id, doc_id AS article_id,
               CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'incorrect' END AS verdict,
               doc_id % 9 + 1 AS articles, doc_id % 13 % 4 AS misplaced, doc_id % 3 AS missing,
               CASE WHEN toxic = 1 THEN 'in_review' ELSE 'done' END AS review_status FROM labels""")
    def reviews(self) -> DataFrame:
        return self.raw("labels").select(
            F.col("doc_id").alias("review_id"),
            F.expr("doc_id div 25").alias("issue_id"),
            F.col("doc_id").alias("article_id"),
            F.expr("case when quality = 1 and toxic = 0 then 'correct' when quality = 1 then 'partial' else 'incorrect' end").alias("verdict"),
            F.expr("doc_id % 9 + 1").alias("articles"),
            F.expr("doc_id % 13 % 4").alias("misplaced"),
            F.expr("doc_id % 3").alias("missing"),
            F.expr("case when toxic = 1 then 'in_review' else 'done' end").alias("review_status"),
        )
