"""Views that give the driver's tables the shapes of enquiry data.

The same SQL text runs on Spark and on DuckDB, so queries and their checks see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Which views a view reads.
NEEDS = {"a_sessions": ["a_turns"]}

VIEWS = {
    "a_leads": """
SELECT o_orderkey AS row_id,
       CAST(o_custkey AS STRING) AS crm_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 WHEN '3' THEN 1 WHEN '4' THEN 0 ELSE -1 END AS label,
       CASE WHEN o_orderkey % 37 = 0 THEN 0 WHEN o_orderkey % 10 = 3 THEN 1 ELSE 2 END AS passport_status,
       CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS has_english_test,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(0.0 AS DOUBLE) WHEN o_orderkey % 9 = 0 THEN CAST(0.0 AS DOUBLE) WHEN o_orderkey % 9 = 3 THEN CAST(5.5 AS DOUBLE) ELSE CAST(7.0 AS DOUBLE) END AS english_band,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS funding_method_present,
       CAST(o_orderkey % 4 AS INT) AS funding_clarity,
       CASE WHEN o_orderkey % 7 < 5 THEN 1 ELSE 0 END AS destination_uk,
       CASE WHEN o_orderkey % 5 < 4 THEN 1 ELSE 0 END AS has_course,
       CASE WHEN o_orderkey % 11 < 8 THEN 1 ELSE 0 END AS has_intake,
       CAST(o_orderkey % 6 AS INT) AS qual_level,
       CASE WHEN o_orderkey % 13 < 4 THEN 1 ELSE 0 END AS study_gap_mentioned,
       CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS previous_application_mentioned,
       CAST(o_orderkey % 53 AS INT) AS note_word_count,
       'real' AS source
FROM orders
""",
    "a_forms": """
SELECT o.o_orderkey AS row_id,
       concat('CRM ', CAST(100000 + o.o_custkey AS STRING)) AS crm_id,
       r.rating, f.funding_method, e.english_test, q.qualifications, d.study_destination, n.assessment_notes,
       x.extra_q, x.extra_a,
       CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE 'MSc Data Science' END AS course,
       CASE WHEN o.o_orderkey % 4 = 0 THEN '  ' ELSE 'September 2026' END AS intake
FROM orders o
JOIN (VALUES (0, 'Cold'), (1, 'good '), (2, 'Excellent'), (3, ''), (4, 'Warm'), (5, 'HOT'), (6, 'NA')) AS r(k, rating) ON o.o_orderkey % 7 = r.k
JOIN (VALUES (0, ''), (1, 'no source of funds'), (2, 'looking for scholarship'), (3, 'Self funded'), (4, 'parents and savings'), (5, 'has finance'), (6, 'wants to attend the expo first'), (7, 'not sure, maybe sponsor'), (8, 'awaiting sponsor')) AS f(k, funding_method) ON o.o_orderkey % 9 = f.k
JOIN (VALUES (0, 'IELTS 6.5'), (1, 'no'), (2, ''), (3, 'KCSE B+'), (4, 'N/A'), (5, 'TOEFL 92')) AS e(k, english_test) ON o.o_orderkey % 6 = e.k
JOIN (VALUES (0, 'BSc'), (1, 'Master of Science in Physics'), (2, 'PhD candidate'), (3, '[UNIVERSITY]'), (4, 'Diploma in ICT'), (5, 'postgraduate'), (6, 'Bachelor of Commerce - Nairobi'), (7, 'foundation year'), (8, 'A levels'), (9, 'certificate')) AS q(k, qualifications) ON o.o_orderkey % 10 = q.k
JOIN (VALUES (0, 'UK'), (1, 'Canada'), (2, 'Ukraine'), (3, ''), (4, 'uk or ireland')) AS d(k, study_destination) ON o.o_orderkey % 5 = d.k
JOIN (VALUES (0, ''), (1, 'Student is yet to renew passport.'), (2, 'Has no passport at the moment.'), (3, 'does not have a plan'), (4, 'doesn''t have a passport'), (5, 'took a gap year'), (6, 'applied to three places'), (7, 'call +254 702 102 295 or mail a.b@example.com'), (8, 'budget 17000 pounds'), (9, 'passport 2024-2034'), (10, 'server 10.0.0.1')) AS n(k, assessment_notes) ON o.o_orderkey % 11 = n.k
JOIN (VALUES (0, 'Any study gap?', 'no'), (1, 'Any study gap?', 'two years'), (2, 'Previous application?', 'not yet'), (3, 'Previous application?', 'Leeds 2023'), (4, 'Hobby', 'chess'), (5, 'Remark', 'none'), (6, 'Study gap reason', ''), (7, 'Application made', '-')) AS x(k, extra_q, extra_a) ON o.o_orderkey % 8 = x.k
""",
    "a_catalog": """
SELECT p.p_partkey AS seq,
       CASE WHEN p.p_partkey % 13 = 0 THEN NULL WHEN p.p_partkey % 17 = 0 THEN '   ' ELSE concat('  ', p.p_name, '   course ') END AS title,
       CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE concat('https://catalog.example/', CAST(p.p_partkey % 97 AS STRING)) END AS url,
       concat(p.p_type, ' ', p.p_brand) AS description,
       l.level, m.study_type,
       concat('£ ', CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS STRING)) AS fees,
       CASE WHEN p.p_partkey % 5 = 0 THEN 'Price on request' WHEN p.p_partkey % 5 = 1 THEN '$1,200 /month' ELSE concat('£', CAST(p.p_size AS STRING), '.50 per week') END AS price,
       concat('inst_', CAST(p.p_partkey % 4 AS STRING)) AS institution,
       CASE WHEN p.p_partkey % 3 = 0 THEN 'accommodation' ELSE 'courses' END AS data_type
FROM part p
JOIN (VALUES (0, 'BSc'), (1, 'msc '), (2, 'Bachelor of Arts with honours'), (3, 'PG'), (4, 'Cert'), (5, ''), (6, 'Short course'), (7, 'Foundation Degree in Art')) AS l(k, level) ON p.p_partkey % 8 = l.k
JOIN (VALUES (0, 'Full-time'), (1, 'PT'), (2, 'Online'), (3, 'evening'), (4, 'sandwich course')) AS m(k, study_type) ON p.p_partkey % 5 = m.k
""",
    "a_turns": """
SELECT concat(CAST(e.user_id AS STRING), '-', substr(CAST(CAST(e.ts AS DATE) AS STRING), 1, 9)) AS session_id,
       e.user_id, e.event_id, e.ts,
       c.category, t.user_msg
FROM events e
JOIN (VALUES ('view', 'Entry Requirements'), ('click', 'Fees & Funding'), ('signup', 'Application Process'), ('purchase', 'English Language'), ('error', 'Visa & Immigration')) AS c(event_type, category) ON e.event_type = c.event_type
JOIN (VALUES (0, 'I can self-fund up to £20,000 but would prefer a partial scholarship'), (1, 'My parents have £15,000 saved for my education'), (2, 'I have no source of funds right now'), (3, 'What is the no visa no pay policy?'), (4, 'Tuition is £15,000 per year'), (5, 'my budget is 9k'), (6, 'I have a passport, IELTS 6.5 and want a masters in September'), (7, 'sponsor pays twenty thousand')) AS t(k, user_msg) ON e.event_id % 8 = t.k
""",
    "a_sessions": """
SELECT session_id, CAST(min(user_id) % 3 AS INT) AS label,
       count(*) AS message_count,
       CAST(sum(length(user_msg) - length(replace(user_msg, ' ', '')) + 1) AS BIGINT) AS session_word_count,
       max(CASE WHEN category = 'Visa & Immigration' THEN 1 ELSE 0 END) AS visa_intent_mentioned,
       CAST(min(event_id) % 4 AS INT) AS funding_clarity, CAST(min(event_id) % 6 AS INT) AS qual_level,
       'synthetic' AS source
FROM a_turns
GROUP BY session_id
""",
    "a_notes": """
SELECT doc_id AS seq, coalesce(split_part(text, chr(10), 1), '') AS record_text FROM documents
""",
    "a_corpus": """
SELECT item_id AS idx,
       substr(text, 1, 60) AS question,
       text AS answer,
       lower(split_part(text, ' ', 2)) AS kw1,
       lower(split_part(text, ' ', 5)) AS kw2,
       concat('cat_', CAST(item_id % 9 AS STRING)) AS category,
       concat('inst_', CAST(item_id % 4 AS STRING)) AS institution
FROM benchmark
""",
    "a_gold": """
SELECT item_id AS query_id,
       substr(text, 20, 45) AS query,
       CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id END AS gold_id,
       item_id % 4 = 0 AS expected_abstain,
       concat('cat_', CAST(item_id % 9 AS STRING)) AS category
FROM benchmark
""",
    "a_px": """
SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS INT) AS label, CAST(o_custkey % 3 AS INT) AS seed,
       CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 3 AS INT) ELSE CAST(o_orderkey % 7 % 3 AS INT) END AS pred_real,
       CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderkey % 3 AS INT) ELSE CAST(o_orderkey % 11 % 3 AS INT) END AS pred_v1,
       CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 3 AS INT) ELSE CAST(o_orderkey % 13 % 3 AS INT) END AS pred_v2,
       CAST(o_orderkey % 10 AS DOUBLE) AS w_cold, CAST(o_orderkey % 6 + 1 AS DOUBLE) AS w_warm, CAST(o_orderkey % 4 AS DOUBLE) AS w_hot,
       CAST(o_orderkey % 100 AS DOUBLE) / 100 AS rule_score
FROM orders
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of one folder."""
    for need in NEEDS.get(name, []):
        view(spark, sf_dir, need).createOrReplaceTempView(need)
    body = VIEWS[name]
    for t in TABLES:
        if t in body:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(body)


def check_sql(sql: str, *views: str) -> str:
    """DuckDB SQL with the named views as common table expressions."""
    names = [n for v in views for n in (*NEEDS.get(v, []), v)]
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(names))
    return f"WITH {parts} {sql}" if parts else sql
