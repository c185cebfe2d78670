"""Retrieval evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from enquira.operators import evaluation as E
from enquira.operators import resampling as S
from enquira.operators import retrieval as R
from enquira.sources.shared import stored

from .entries import query
from .q_retrieval import BOTH, OVERLAP, SCORED, faq, gold, overlap_hits, scored_hits

_OVER = f"SELECT query_id, idx, rank, score, score AS cosine FROM ({OVERLAP})"


def _pq(hits: str, gate: float = 0.15) -> str:
    return f"""SELECT g.query_id, g.category, g.expected_abstain, coalesce(t.top1, 0) AS top1, coalesce(t.raw, 0) AS raw, r.rank, coalesce(t.top1 < {gate}, true) AS predicted_abstain,
      coalesce(t.top1 < {gate}, true) = g.expected_abstain AS correct, coalesce(r.rank <= 3, false) AS recall3, coalesce(r.rank <= 5, false) AS recall5, NOT g.expected_abstain AND coalesce(t.top1 < {gate}, true) AS false_abstention
      FROM a_gold g LEFT JOIN (SELECT query_id, max(score) AS top1, max(cosine) AS raw FROM ({hits}) GROUP BY query_id) t ON g.query_id = t.query_id
      LEFT JOIN (SELECT h.query_id, min(h.rank) AS rank FROM ({hits}) h JOIN a_gold x ON h.query_id = x.query_id AND h.idx = x.gold_id GROUP BY h.query_id) r ON g.query_id = r.query_id"""


def _mean(v: str) -> str:
    return f"round(coalesce(avg(CASE WHEN NOT expected_abstain THEN {v} END), 0), 4)"


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN count_if({b}) > 0 THEN count_if({a})::DOUBLE / count_if({b}) ELSE 0 END, 4)"


_RANKED = f"{_mean('CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END')} AS rank1, {_mean('coalesce(1.0::DOUBLE / rank, 0)')} AS mrr, {_mean('recall3::INT::DOUBLE')} AS recall3"
_METRICS = f"""{_RANKED}, {_mean('recall5::INT::DOUBLE')} AS recall5, {_ratio('predicted_abstain AND expected_abstain', 'predicted_abstain')} AS abstention_precision,
  {_ratio('predicted_abstain AND expected_abstain', 'expected_abstain')} AS abstention_recall, {_ratio('predicted_abstain AND NOT expected_abstain', 'NOT expected_abstain')} AS false_abstention_rate"""


def run_a(spark, d):
    return E.per_query(scored_hits(spark, d), gold(spark, d), 0.15)


def run_b(spark, d):
    return E.per_query(overlap_hits(spark, d).withColumn("cosine", F.col("score")), gold(spark, d), 0.15)


@query("eval_per_query", _pq(SCORED), BOTH)
def eval_per_query(spark, d):
    return run_a(spark, d)


@query("eval_summary", f"SELECT count(*) AS n, count_if(NOT expected_abstain) AS n_answerable, {_METRICS}, round(avg(top1), 4) AS mean_top1, round(stddev_pop(top1), 4) AS std_top1 FROM ({_pq(SCORED)})", BOTH)
def eval_summary(spark, d):
    return E.summary(run_a(spark, d))


@query("eval_by_category", f"SELECT category, count(*) AS n, count_if(NOT expected_abstain) AS n_answerable, {_RANKED}, count_if(NOT expected_abstain) < 5 AS thin FROM ({_pq(SCORED)}) GROUP BY category", BOTH)
def eval_by_category(spark, d):
    return E.by_category(run_a(spark, d))


@query(
    "threshold_sweep",
    f"SELECT gate::DOUBLE AS gate, {_METRICS} FROM (SELECT * EXCLUDE (predicted_abstain), raw = 0 OR top1 < gate AS predicted_abstain FROM ({_pq(SCORED, 0.0)}) CROSS JOIN (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) v(gate)) GROUP BY gate",
    BOTH,
)
def threshold_sweep(spark, d):
    return E.threshold_sweep(scored_hits(spark, d), gold(spark, d))


_CMP = f"""SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, CASE WHEN coalesce(b.rank, 1073741824) < coalesce(a.rank, 1073741824) THEN 'win' WHEN coalesce(b.rank, 1073741824) > coalesce(a.rank, 1073741824) THEN 'loss' ELSE 'tie' END AS outcome,
  (coalesce(a.rank, 9) = 1) <> (coalesce(b.rank, 9) = 1) AS flip FROM ({_pq(SCORED)}) a JOIN ({_pq(_OVER)}) b ON a.query_id = b.query_id WHERE NOT a.expected_abstain"""


@query("compare_runs", _CMP, BOTH)
def compare_runs(spark, d):
    return E.compare_runs(run_a(spark, d), run_b(spark, d))


_BY_RUN = " UNION ALL ".join(
    f"SELECT '{r}' AS run, {_METRICS}, round(avg(raw), 4) AS mean_raw, round(avg(CASE WHEN NOT expected_abstain THEN raw END), 4) AS mean_raw_answerable, {_mean('(raw > 0.8)::INT::DOUBLE')} AS share_above_80, {_mean('(raw > 0.6)::INT::DOUBLE')} AS share_above_60 FROM ({_pq(h)})"
    for r, h in (("a", SCORED), ("b", _OVER))
)
_NAMES = ["rank1", "mrr", "recall3", "recall5", "abstention_precision", "abstention_recall", "false_abstention_rate", "mean_raw", "mean_raw_answerable", "share_above_80", "share_above_60"]


@query(
    "compare_summary",
    f"SELECT * FROM (WITH per AS MATERIALIZED ({_BY_RUN}) SELECT * FROM per UNION ALL SELECT 'delta', " + ", ".join(f"round(sum(CASE WHEN run = 'b' THEN {c} ELSE -{c} END), 4)" for c in _NAMES) + " FROM per)",
    BOTH,
)
def compare_summary(spark, d):
    return E.compare_summary(run_a(spark, d).withColumn("run", F.lit("a")).unionByName(run_b(spark, d).withColumn("run", F.lit("b"))))


_RR = f"SELECT query_id AS id, a, b FROM (SELECT query_id, coalesce(1.0::DOUBLE / rank_a, 0) AS a, coalesce(1.0::DOUBLE / rank_b, 0) AS b FROM ({_CMP}))"


def _h(seed: str, c: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {c}), 1, 8) AS BIGINT)"


def _boot(rows: str, resamples: int) -> str:
    """n, delta, mean, low and high of a table (id, a, b)."""
    return f"""SELECT * FROM (WITH rr AS MATERIALIZED ({rows}) SELECT * FROM (SELECT count(*) AS n, round(avg(b - a), 6) AS delta FROM rr) CROSS JOIN (SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (
      SELECT g.r, avg(x.diff) AS m FROM (SELECT unnest(range({resamples})) AS r) g CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM rr))) AS j) j JOIN (SELECT row_number() OVER (ORDER BY {_h('number', 'id')}, id) - 1 AS i, b - a AS diff FROM rr) x
      ON x.i = {_h('s', "g.r || ':' || j.j")} % (SELECT count(*) FROM rr) GROUP BY g.r)))"""


@query("paired_bootstrap", _boot(_RR, 1000), BOTH)
def paired_bootstrap(spark, d):
    found = compare_runs(spark, d)
    return E.paired_bootstrap(found.select(F.col("query_id").alias("id"), F.coalesce(1 / F.col("rank_a"), F.lit(0.0)).alias("a"), F.coalesce(1 / F.col("rank_b"), F.lit(0.0)).alias("b")))


def weights_sql(cells: str, resamples: int, seed: str) -> str:
    """(r, cell, w) of a table (cell, n), as ``resampling.weights`` draws them."""
    key = "g.r || ':' || c.cell || ':' || b.bit"
    normal = f"sqrt(-2 * ln((h + 1) / {2.0**32})) * cos(h2 * {2 * math.pi / 2.0**32!r})"
    return f"""SELECT r, cell, sum(w) AS w FROM (
      SELECT r, cell, CASE WHEN bit <= {S.EXACT_BIT} THEN len(list_filter({S.STEPS}[bit + 1], lambda x: x <= h)) ELSE CAST(greatest(floor(pow(2.0::DOUBLE, bit) + sqrt(pow(2.0::DOUBLE, bit)) * {normal} + 0.5), 0) AS BIGINT) END AS w FROM (
        SELECT g.r, c.cell, b.bit, {_h(seed, key)} AS h, {_h(f"{seed}-2", key)} AS h2 FROM ({cells}) c JOIN (SELECT unnest(range(41)) AS bit) b ON (c.n >> b.bit) & 1 = 1 CROSS JOIN (SELECT unnest(range({resamples})) AS r) g)) GROUP BY r, cell HAVING sum(w) > 0"""


INTERVAL = "round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high"
_CELLS = f"SELECT CAST(round((b - a) * 1000000) AS BIGINT) AS cell, count(*) AS n FROM ({_RR}) GROUP BY 1"


@query(
    "paired_bootstrap_cells",
    f"""SELECT * FROM (WITH cells AS MATERIALIZED ({_CELLS}) SELECT * FROM (SELECT coalesce(sum(n), 0)::BIGINT AS n, round(sum(n * cell) / sum(n) / 1000000, 6) AS delta FROM cells)
      CROSS JOIN (SELECT {INTERVAL.format('m')} FROM (SELECT r, sum(w * cell) / sum(w) / 1000000 AS m FROM ({weights_sql('SELECT * FROM cells', 1000, 's')}) GROUP BY r)))""",
    BOTH,
)
def paired_bootstrap_cells(spark, d):
    found = compare_runs(spark, d)
    return E.paired_bootstrap(found.select(F.col("query_id").alias("id"), F.coalesce(1 / F.col("rank_a"), F.lit(0.0)).alias("a"), F.coalesce(1 / F.col("rank_b"), F.lit(0.0)).alias("b")), mode="cells")


_GONE = f"SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY {_h('w', 'idx')}, idx) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT gold_id AS idx FROM a_gold WHERE gold_id IS NOT NULL)) WHERE r <= greatest(floor(n * CAST(0.3 AS DOUBLE) + 0.5), 1)"


@query("withhold_corpus", _GONE, BOTH)
def withhold_corpus(spark, d):
    return E.withhold(gold(spark, d), faq(spark, d))[0]


def _run_on(spark, d, corpus):
    postings, idf = R.tfidf_index(corpus)
    hits = R.keyword_bonus(R.tfidf_search(gold(spark, d), postings, idf), gold(spark, d), corpus)
    return E.per_query(hits, gold(spark, d), 0.15)


def reduced_run(spark, d):
    gone, rest = E.withhold(gold(spark, d), faq(spark, d))
    return gone, _run_on(spark, d, rest)


# the same search over a corpus without some rows: the view's name is exchanged in the SQL of the search
def _without(ids: str) -> str:
    return _pq(SCORED.replace("FROM a_corpus", f"FROM (SELECT * FROM a_corpus WHERE idx NOT IN ({ids}))"))


_COLD = _without(_GONE)
_GAPS = f"SELECT query_id, category, CASE WHEN rank IS NULL THEN 'not_retrieved' ELSE 'low_rank' END AS reason, predicted_abstain AS below_gate FROM ({_COLD}) WHERE query_id % 2 = 1 AND NOT expected_abstain AND (rank IS NULL OR rank > 3)"
_BACK = f"SELECT idx FROM ({_GONE}) WHERE idx IN (SELECT gold_id FROM a_gold WHERE query_id % 2 = 1 AND gold_id IS NOT NULL) OR idx IN (SELECT idx FROM a_corpus WHERE category IN (SELECT category FROM ({_GAPS})))"


@query("probe_gaps", _GAPS, BOTH)
def probe_gaps(spark, d):
    return E.probe_gaps(reduced_run(spark, d)[1].where("query_id % 2 = 1"))


def _targeted(spark, d, gone, cold):
    probes = gold(spark, d).where("query_id % 2 = 1")
    return E.targeted_restore(E.probe_gaps(cold.where("query_id % 2 = 1")), probes, gone, faq(spark, d))


@query("targeted_restore", _BACK, BOTH)
def targeted_restore(spark, d):
    return _targeted(spark, d, *reduced_run(spark, d))


_TARGETED = _without(f"SELECT idx FROM ({_GONE}) WHERE idx NOT IN (SELECT idx FROM ({_BACK}))")
_STAGES = " UNION ALL ".join(f"SELECT '{stage}' AS stage, * FROM {part} WHERE query_id % 2 = 0" for stage, part in (("full", "whole"), ("cold", "cold"), ("restored", "whole"), ("targeted", "targeted")))
_BOTH_RECALLS = ("recall3", "recall5")
_HELD = f"""SELECT query_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (x), '') AS cell FROM (
  SELECT query_id, stage || '/' || m.metric AS k, CASE m.metric WHEN 'recall3' THEN recall3 ELSE recall5 END AS x FROM stages CROSS JOIN (VALUES ('recall3'), ('recall5')) m(metric) WHERE NOT expected_abstain) GROUP BY query_id"""
_GAINED = "sum(w * (list_contains(string_split(cell, ','), stage || '/' || metric)::INT - list_contains(string_split(cell, ','), 'cold/' || metric)::INT)) / sum(w)"
_EXTRA = ", ".join(
    f"round(p.{m} - k.cold_{m}, 4) AS gain_{m}, round(CASE WHEN k.full_{m} - k.cold_{m} <> 0 THEN (p.{m} - k.cold_{m}) / (k.full_{m} - k.cold_{m}) END, 4) AS recovery_{m}, round(k.restored_{m} - p.{m}, 4) AS residual_{m}, b.low_{m}, b.high_{m}"
    for m in _BOTH_RECALLS
)
_REPORT = f"""SELECT * FROM (WITH whole AS MATERIALIZED ({_pq(SCORED)}), cold AS MATERIALIZED ({_COLD}), targeted AS MATERIALIZED ({_TARGETED}), stages AS MATERIALIZED ({_STAGES}),
  per AS (SELECT stage, {_METRICS} FROM stages GROUP BY stage),
  marks AS (SELECT {', '.join(f"max(CASE WHEN stage = '{s}' THEN {m} END) AS {s}_{m}" for s in ('full', 'cold', 'restored') for m in _BOTH_RECALLS)} FROM per),
  cells AS MATERIALIZED (SELECT cell, count(*) AS n FROM ({_HELD}) GROUP BY cell),
  drawn AS MATERIALIZED (SELECT r, stage, metric, {_GAINED} AS v FROM ({weights_sql('SELECT * FROM cells', 1000, 'g')}) CROSS JOIN (VALUES ('full'), ('restored'), ('targeted')) s(stage) CROSS JOIN (VALUES ('recall3'), ('recall5')) m(metric) GROUP BY r, stage, metric),
  boot AS (SELECT stage, {', '.join(f"round(quantile_cont(v, {q}) FILTER (metric = '{m}'), 6) AS {e}_{m}" for m in _BOTH_RECALLS for e, q in (('low', 0.025), ('high', 0.975)))} FROM drawn GROUP BY stage)
  SELECT p.*, {_EXTRA} FROM per p CROSS JOIN marks k LEFT JOIN boot b ON p.stage = b.stage)"""


@query("adaptation_report", _REPORT, BOTH)
def adaptation_report(spark, d):
    """Metrics of the test half with the full, the reduced, the fully restored and the restored corpus; each search runs once."""
    gone, cold = reduced_run(spark, d)
    gone, cold = stored(gone, "gone"), stored(cold, "cold")
    back = _targeted(spark, d, gone, cold)
    restored = _run_on(spark, d, faq(spark, d).join(gone.join(back, "idx", "left_anti"), "idx", "left_anti"))
    full = stored(run_a(spark, d), "full")
    rows = None
    for name, part in (("full", full), ("cold", cold), ("restored", full), ("targeted", restored)):
        part = part.where("query_id % 2 = 0").withColumn("stage", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    rows = stored(rows, "stages")
    return E.adaptation_report(rows, S.gain_cells(rows.where("not expected_abstain"), _BOTH_RECALLS, "cold", 1000))
