"""Matrices, models, questions and intervals against hand-computed rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from enquira.operators import catalog, evaluation, forms, matrix, mltables, models

COLUMNS = [*dict.fromkeys([*mltables.FEATURES, *mltables.NUMERIC])]


def leads(spark, *rows):
    """Rows of (row_id, label, {feature: value}); absent features are missing."""
    data = [(i, label, "real", *(None if f.get(c) is None else float(f[c]) for c in COLUMNS)) for i, label, f in rows]
    return spark.createDataFrame(data, "row_id long, label int, source string, " + ", ".join(f"{c} double" for c in COLUMNS))


def many(spark, n=120):
    return leads(spark, *((i, i % 3, {"note_word_count": 10 * (i % 3) + i % 4, "funding_clarity": i % 3, "passport_status": 2, "qual_level": i % 3, "message_count": i}) for i in range(n)))


def test_matrix(spark):
    table, names = matrix.build_matrix(leads(spark, (1, 0, {"note_word_count": 2, "passport_status": 2}), (2, 1, {"note_word_count": 5}), (3, 2, {"passport_status": 0})))
    rows = {r.row_id: r for r in table.collect()}
    assert [rows[i].note_word_count for i in (1, 2, 3)] == [2.0, 5.0, 3.5] and rows[1].message_count == 0.0
    assert [n for n in names if n.startswith("passport")] == ["passport_status_0", "passport_status_2", "passport_status_unknown"]
    assert [(rows[i].passport_status_0, rows[i].passport_status_2, rows[i].passport_status_unknown) for i in (1, 2, 3)] == [(0, 1, 0), (0, 0, 1), (1, 0, 0)]
    fewer = matrix.build_matrix(many(spark), drop_english=True, drop_engagement=True)[1]
    assert "has_english_test" not in fewer and not set(fewer) & set(mltables.ENGAGEMENT)


def test_live_rows(spark):
    live = spark.createDataFrame([("s", 1, "2.0", 7.0, 1), ("t", None, "9", None, None)], "session_id string, has_course int, qual_level string, engagement_message_count double, flags_visa_intent_mentioned int")
    rows = {r.session_id: r for r in matrix.inference_matrix(live, {"message_count": 3.0, "note_word_count": 4.0}, {"has_course": "0"}).collect()}
    s, t = rows["s"], rows["t"]
    assert (s.message_count, s.visa_intent_mentioned, s.note_word_count, s.avg_delay_s) == (7.0, 1.0, 4.0, 0.0) and (t.message_count, t.visa_intent_mentioned) == (3.0, 0.0)
    assert (s.has_course_1, s.has_course_0, t.has_course_0, s.qual_level_2) == (1, 0, 1, 1) and sum(t[f"qual_level_{k}"] for k in range(6)) == 0  # an unknown value
    assert s.passport_status_2 == 1 and s.destination_uk_1 == 1  # built-in modes
    assert matrix.inference_matrix(live, {}, {}, ["note_word_count", "has_course_1"]).columns == ["session_id", *mltables.NUMERIC, "has_course_1"]


def test_models(spark):
    rows = mltables.stratified_split(many(spark))
    train, names = matrix.build_matrix(rows.where("not holdout"))
    test = matrix.build_matrix(rows.where("holdout"))[0]
    for kind, right in (("rf", 1.0), ("logreg", 1.0), ("dummy", 1 / 3)):
        found = models.predict_proba(models.train_model(train, names, kind, trees=10, iterations=50), test.drop(names[-1]))
        total = found.select(F.avg((F.col("label") == F.col("pred")).cast("double")), F.min(F.col("p_cold") + F.col("p_warm") + F.col("p_hot"))).first()
        assert abs(total[0] - right) < 0.1 and abs(total[1] - 1) < 1e-9, kind
    assert models.predict_proba(None, test).select("p_hot").distinct().collect()[0][0] is None
    with pytest.raises(ValueError, match="unknown kind"):
        models.train_model(train, names, "svm")
    top = models.feature_importance(models.train_model(train, names, trees=10), spark).first()
    assert top.feature in ("note_word_count", "funding_clarity") or top.feature.startswith("qual_level")


def test_experiments(spark):
    rows = many(spark).fillna(0.0, mltables.FEATURES).withColumn("qual_level", F.col("qual_level").cast("int")).withColumn("group_id", F.concat(F.lit("g"), (F.col("row_id") / 3).cast("int").cast("string")))
    folds = mltables.fold_groups(rows, 4).groupBy("group_id").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert folds == 1
    swept = models.alpha_oof(rows, k=3, kind="logreg", iterations=10).collect()
    assert len(swept) == 22 and {r.folds for r in swept} == {"grouped", "rows"} and max(r.macro_f1 for r in swept if r.alpha == 0) > 0.9
    cv = {r.metric: r for r in models.exp_cv(rows, k=3, kind="logreg", iterations=10).collect()}
    assert set(cv) == {"macro_f1", "f1_0", "f1_1", "f1_2"} and cv["macro_f1"].n == 3 and cv["macro_f1"].low <= cv["macro_f1"].mean <= cv["macro_f1"].high
    split = mltables.stratified_split(rows)
    held = split.where("holdout").select("row_id").first()[0]
    made = many(spark, 30).withColumn("source_row_id", F.lit(held))
    with pytest.raises(AssertionError, match="held-out"):
        models.exp_generalization(split, made, kind="dummy")
    same = {r.metric: r for r in models.exp_generalization(split, many(spark, 60), kind="logreg", iterations=10).collect()}
    assert same["macro_f1"].real > 0.9 and abs(same["macro_f1"].delta - (same["macro_f1"].augmented - same["macro_f1"].real)) < 1e-6
    model = models.label_model(many(spark), trees=5)
    assert not set(model.names) & set(mltables.ENGAGEMENT)
    pool = [(0, 0, "Cold", 0, 0.8, 0.1, 0.1), (1, 0, "Cold", 1, 0.2, 0.5, 0.3), (1, 2, "Hot", 1, 0.2, 0.5, 0.3)]
    table = spark.createDataFrame(pool, "label int, source_label int, lead_label string, pred int, p_cold double, p_warm double, p_hot double")
    got = {r.label: (r.n, r.vs_model, r.vs_rubric, r.vs_source, r.mean_confidence) for r in mltables.generated_agreement(table).collect()}
    assert got == {-1: (3, 1.0, 0.333333, 0.333333, 0.6), 0: (1, 1.0, 1.0, 1.0, 0.8), 1: (2, 1.0, 0.0, 0.0, 0.5)}


def test_topics(spark):
    words = {"visa": "passport visa permit", "fees": "tuition price cost", "rooms": "housing room flat"}
    rows = [(i, f"{list(words.values())[i % 3]} number{i}", list(words)[i % 3]) for i in range(30)] + [(99, "  ", "visa")]
    docs = spark.createDataFrame(rows, "row_id long, text string, topic string")
    model = models.topic_train(docs, iterations=20)
    found = {r.row_id: r for r in models.topic_predict(model, docs, k=2).collect()}
    assert all(found[i].predicted == list(words)[i % 3] and len(found[i].top) == 2 and found[i].top[0].p == found[i].confidence for i in range(30))
    assert found[99].predicted == "General Enquiries" and found[99].top == []
    assert models.topic_predict(None, docs).select("predicted").distinct().collect()[0][0] == "General Enquiries"
    report = models.topic_report(spark.createDataFrame([(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (1, "a", "a")], "fold int, topic string, predicted string")).collect()
    assert {(r.fold, r.topic): (r.support, r.f1, r.macro_f1) for r in report} == {(0, "a"): (2, 0.666667, 0.666667), (0, "b"): (1, 0.666667, 0.666667), (1, "a"): (1, 1.0, 1.0)}
    assert report[0].mean_macro_f1 == 0.833333 and report[0].std_macro_f1 == 0.166667
    assert models.topic_folds(docs.where("row_id < 30"), k=3, iterations=10).where("topic = predicted").count() == 30


def test_related_questions(spark):
    faq = [(i, q, a, k1, k2) for i, (q, a, k1, k2) in enumerate([
        ("What visa do I need?", "A student visa for the UK", "visa", "permit"), ("How much are fees?", "Fees are 9,250 pounds", "fees", "tuition"), ("Is there housing?", "Rooms on campus", "housing", "room"),
        ("Which masters in data science?", "MSc data science, one year", "data", "science"), ("MSc Data Science fees", "See the fee table for science", "fees", "science"),
    ])]
    faq += [(10, "admission deadline", "x", "y", "z"), (11, "admission deadlines!", "x", "y", "z"), (12, "q" * 3000, "", "", ""), (13, "", "", "", "")]
    records = [(1, "MSc Data Science with fees of 12,000 pounds"), (2, "Student housing and a room near campus"), (3, ""), (4, "zzz qqq"), (5, "visa fees housing data the and is")]
    records += [(6, "admissions deadlines"), (7, "Admissions  deadlines"), (8, "q" * 2500), (9, "!!!"), (10, "admissions")]
    r, f = spark.createDataFrame(records, "seq long, record_text string"), spark.createDataFrame(faq, "idx long, question string, answer string, kw1 string, kw2 string")

    def tokens(s):
        return set("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())

    expected = {}
    for seq, said in records:
        scores = []
        for i, q, a, k1, k2 in faq:
            have = tokens(said)
            cover = sum(w * len(have & tokens(s)) / max(1, len(tokens(s))) for w, s in ((0.45, f"{k1} {k2}"), (0.25, q), (0.15, a)))
            score = cover + 0.15 * SequenceMatcher(None, said.lower()[:2000], q.lower()).ratio() if have else 0.0
            if score >= 0.10:
                scores.append((-score, i))
        expected[seq] = [(i, round(-s, 4)) for s, i in sorted(scores)[:3]]
    got = {x.seq: [(y.idx, y.score) for y in x.related] for x in catalog.related_faqs(r, f).collect()}
    assert got == expected and len(expected[1]) == 3 and expected[3] == expected[4] == []
    exact = {(x.seq, x.idx): x.score for x in catalog.faq_similarity(r, f).collect()}
    assert [y[0] for y in expected[6]] == [11, 10] and expected[8] and expected[9] == []
    assert len(exact) == len(records) * len(faq) and all(abs(x.score - exact[x.seq, x.idx]) < 1e-9 for x in catalog.faq_similarity(r, f, "candidates").collect())


def test_quality_of_records(spark):
    rows = [(1, "5", "Good", "Jo Do", "clean", "BSc"), (2, "", "Good", "[COUNSELLOR_ID]", "clean", ""), (3, "5", "Cold", "", "call 0716524788", ""), (4, "5", "", "", "", "")]
    flagged = forms.quality_flag(spark.createDataFrame(rows, "i int, crm_id string, rating string, counsellor_id string, assessment_notes string, qualifications string"))
    got = {r.i: (r.quality_flag, r.pii_issues, r.counsellor_id) for r in flagged.collect()}
    assert got == {1: ("CLEAN", "", "[NAME_REDACTED]"), 2: ("CHECK", "", "[COUNSELLOR_ID]"), 3: ("REVIEW", "PII not fully redacted", ""), 4: ("CHECK", "", "")}
    counts = {(r.kind, r.name): r.n for r in forms.quality_summary(flagged).collect()}
    assert counts == {("total", ""): 4, ("flag", "CLEAN"): 1, ("flag", "CHECK"): 2, ("flag", "REVIEW"): 1, ("rating", "Good"): 2, ("rating", "Cold"): 1, ("rating", ""): 1, ("pii_left", ""): 1}


def test_adaptation(spark):
    rows = []
    for stage, ranks in (("full", [1, 2, 3, 1]), ("cold", [None, None, 3, 1]), ("restored", [1, 2, 3, 1]), ("targeted", [1, None, 3, 1])):
        rows += [(stage, i, "c", False, r, r is not None and r <= 3, r is not None and r <= 5, False) for i, r in enumerate(ranks)]
    stages = spark.createDataFrame(rows, "stage string, query_id int, category string, expected_abstain boolean, rank int, recall3 boolean, recall5 boolean, predicted_abstain boolean")
    boot = spark.createDataFrame([("targeted", "recall3", 0.0, 0.5)], "stage string, metric string, low double, high double")
    got = {r.stage: r for r in evaluation.adaptation_report(stages, boot).collect()}
    assert (got["cold"].recall3, got["cold"].recovery_recall3, got["targeted"].gain_recall3, got["targeted"].recovery_recall3, got["targeted"].residual_recall3) == (0.5, 0.0, 0.25, 0.5, 0.25)
    assert (got["restored"].recovery_recall3, got["targeted"].low_recall3, got["targeted"].high_recall3, got["restored"].low_recall3) == (1.0, 0.0, 0.5, None)


def test_imputation_share(spark):
    importance = spark.createDataFrame([("message_count", 0.25), ("session_word_count", 0.5), ("qual_level_2", 0.25)], "feature string, importance double")
    got = {r.key: (r.number, r.text) for r in mltables.imputation_table(leads(spark, (1, 0, {"note_word_count": 2, "qual_level": 3})), importance).collect()}
    assert got["engagement_importance_share"] == (0.75, None) and got["mode_qual_level"] == (None, "3") and got["mode_has_course"] == (None, "unknown")
    assert got["median_note_word_count"] == (2.0, None) and got["median_message_count"] == (0.0, None) and got["rows_real"] == (1.0, None)


def test_related_questions_lose_nothing(spark):
    """First lines of documents and changed copies of the questions, against all pairs."""
    faq = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS idx", "substr(text, 1, 60) AS question", "text AS answer", "lower(split_part(text, ' ', 2)) AS kw1", "'' AS kw2")
    notes = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS seq", "coalesce(split_part(text, chr(10), 1), '') AS record_text")
    forms = faq.selectExpr("100000 + idx AS seq", "regexp_replace(lower(question), '([a-z]+)', '$1x') AS record_text")  # no token is shared
    records = notes.unionByName(forms)
    ranked = catalog.faq_similarity(records, faq).where("score >= 0.1").withColumn("rank", F.expr("row_number() OVER (PARTITION BY seq ORDER BY score DESC, idx)")).where("rank <= 3")
    exact = {}
    for r in ranked.orderBy("seq", "rank").collect():
        exact.setdefault(r.seq, []).append((r.idx, round(r.score, 4)))
    got = {r.seq: [(x.idx, x.score) for x in r.related] for r in catalog.related_faqs(records, faq).collect()}
    assert {k: v for k, v in got.items() if v} == exact and len(got) == records.count()
    covered = {(r.seq, r.idx) for r in catalog.coverage_candidates(records, faq).collect()}
    assert any((seq, idx) not in covered for seq, found in exact.items() for idx, _ in found)


def test_topic_terms_are_read_once(spark):
    """Ties of the vocabulary go by order, texts may be split before, and counts may be given."""
    docs = spark.createDataFrame([(i, "zeta alpha" if i % 2 else "mid alpha", "ab"[i % 2]) for i in range(20)], "row_id long, text string, topic string")
    terms = models.topic_terms(docs)
    assert sorted(terms.first().terms) in (["alpha", "zeta", "zeta alpha"], ["alpha", "mid", "mid alpha"])
    counts = models.term_counts(terms)
    for given in (None, counts):
        model = models.topic_train(terms, iterations=5, vocabulary=2, counts=given)
        assert sorted(model.fitted.stages[3].vocabulary) == ["alpha", "mid"]  # of the terms found ten times the first
    asked = [[(r.row_id, r.predicted, r.confidence) for r in models.topic_predict(model, x).orderBy("row_id").collect()] for x in (docs, terms)]
    assert asked[0] == asked[1]


def test_fits_read_a_written_matrix(spark):
    from enquira.plans import q_models

    train, held, _ = q_models._matrix(spark, "/root/testdata/sf0.001")
    for rows in (train, held):
        assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_a_regression_is_fitted_over_cells(spark, monkeypatch):
    """Repeated rows are one cell, with and without weights, and the coefficients are those over rows and standardised columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = leads(spark, *((i, (i * i + i // 7) % 3, {"note_word_count": i % 5, "funding_clarity": i % 3, "qual_level": i % 4}) for i in range(300)))
    table, names = matrix.build_matrix(rows, drop_engagement=True)
    fitted = []
    over = models._weighted
    monkeypatch.setattr(models, "_weighted", lambda cells: fitted.append(cells.count()) or over(cells))
    for weighted in (models.with_weights(table), table.withColumn("weight", 1.0 + F.col("row_id") % 2)):
        given = table if not fitted else weighted
        stages = [VectorAssembler(inputCols=names, outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="label", weightCol="weight", maxIter=20, regParam=1 / 300)]
        want = Pipeline(stages=stages).fit(weighted.select("label", "weight", *names))
        got = models.train_model(given, names, "logreg", iterations=20)
        assert abs(want.stages[-1].coefficientMatrix.toArray() - got.fitted.stages[-1].coefficientMatrix.toArray()).max() < 1e-4
        a, b = want.transform(table).select("row_id", "probability"), models.predict_proba(got, table).select("row_id", *models.PROBABILITIES)
        held = {r[0]: r[1].toArray() for r in a.collect()}
        assert max(abs(held[r[0]] - r[1:]).max() for r in b.collect()) < 1e-5
    assert len(fitted) == 2 and max(fitted) <= 180


def test_label_matrix_is_written_once_and_forests_keep_nodes(spark):
    model, table = models.label_matrix_model(many(spark), trees=3)
    assert table.inputFiles() and model.fitted.stages[-1].getCacheNodeIds() and "label" in table.columns
