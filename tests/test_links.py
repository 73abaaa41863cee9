"""Links of reports and news against meeting every candidate."""

import random
from datetime import date

from scorewright.operators import crossval as X

TOPICS = [*X.TOPIC_GROUPS[0], *X.TOPIC_GROUPS[1], "other", "else", None]
TYPES = [*X.CLOSE_TYPES, "risk", "outlook", None]
WAYS = ["increased", "decreased", "cautious", "optimistic", "Improved", "unknown", None]


def test_best_report_against_all_reports(spark):
    rng = random.Random(3)
    reports = [(i, rng.choice(("A", "B", "C")), rng.choice((None, 2018, 2019, 2020, 2022)), i * 7 % 61) for i in range(60)]
    news = [(i, rng.choice(("A", "B", "C", "D", None)), rng.choice((None, date(rng.randint(2016, 2024), rng.randint(1, 12), 3))), "kept") for i in range(200)]

    def fit(published, year):
        if published is None or year is None:
            return 1
        same = published.year == year
        return (2 if same or (published.year == year + 1 and published.month <= 6) else 1) + same

    want = {}
    for i, ticker, published, _ in news:
        own = [r for r in reports if r[1] == ticker]
        if own:
            want[i] = max(own, key=lambda r: (fit(published, r[2]), -r[3]))[0]
    n = spark.createDataFrame(news, "news_claim_id int, ticker string, publish_date date, more string")
    r = spark.createDataFrame(reports, "mda_document_id int, ticker string, report_year int, mda_ord int")
    got = X.best_documents(n, r)
    assert got.columns == ["news_claim_id", "ticker", "publish_date", "more", "mda_document_id", "report_year"]
    assert {x["news_claim_id"]: x["mda_document_id"] for x in got.collect()} == want
    assert got.count() == len(want)


def plus(news, claim) -> tuple | None:
    """(tier, score, order) of a candidate, as the rules say it; None if it is none."""
    close = news["topic"] is not None and claim["topic"] is not None and (news["topic"] == claim["topic"] or any(news["topic"] in g and claim["topic"] in g for g in X.TOPIC_GROUPS))
    kind = news["claim_type"] is not None and claim["claim_type"] is not None and (news["claim_type"] == claim["claim_type"] or {news["claim_type"], claim["claim_type"]} <= set(X.CLOSE_TYPES))
    if not (close or kind):
        return None
    same = lambda k: news[k] is not None and news[k] == claim[k]
    a, b = (claim["direction"] or "").lower(), (news["direction"] or "").lower()
    conflict = (a in X.UP and b in X.DOWN) or (a in X.DOWN and b in X.UP)
    score = 3 * same("topic") + 2 * same("claim_type") + 2 * (same("metric_name") and news["metric_name"] != "") + 4 * conflict + 4 * (claim["direction"] == "cautious" and news["direction"] == "optimistic")
    return close, score, -claim["claim_ord"]


def test_linked_claims_against_all_claims(spark):
    rng = random.Random(8)
    labels = lambda: {"topic": rng.choice(TOPICS), "claim_type": rng.choice(TYPES), "metric_name": rng.choice(("revenue", "profit", "", None)), "direction": rng.choice(WAYS)}
    # one report has most claims, some have one, one has none
    claims = [labels() | {"claim_id": i, "mda_document_id": 1 if i < 400 else 2 + i % 30, "claim_ord": i * 37 % 509} for i in range(450)]
    news = [labels() | {"news_claim_id": i, "mda_document_id": rng.choice((1, 1, *range(2, 34)))} for i in range(300)]
    c = spark.createDataFrame([tuple(x.values()) for x in claims], "topic string, claim_type string, metric_name string, direction string, claim_id int, mda_document_id int, claim_ord int")
    n = spark.createDataFrame([tuple(x.values()) for x in news], "topic string, claim_type string, metric_name string, direction string, news_claim_id int, mda_document_id int")
    got = {r["news_claim_id"]: r["m_claim_id"] for r in X.linked_claims(n, c).collect()}
    want = {}
    for x in news:
        found = [(k, y["claim_id"]) for y in claims if y["mda_document_id"] == x["mda_document_id"] for k in [plus(x, y)] if k]
        want[x["news_claim_id"]] = max(found)[1] if found else None
    assert got == want


def test_a_very_popular_report_meets_few_rows(spark):
    """Thousands of claims of one report and as many news: what the joins make follows the labels, not the claims."""
    n = 20_000
    news = spark.range(n).selectExpr("id as news_claim_id", "1L as mda_document_id", "element_at(array('cost', 'margin', 'risk'), int(id % 3) + 1) as topic", "'risk' as claim_type", "element_at(array('a', 'b'), int(id % 2) + 1) as metric_name", "'increased' as direction")
    claims = spark.range(n).selectExpr("id as claim_id", "1L as mda_document_id", "element_at(array('cost', 'margin', 'risk'), int(id % 3) + 1) as topic", "'outlook' as claim_type", "element_at(array('b', 'c'), int(id % 2) + 1) as metric_name", "element_at(array('decreased', 'x'), int(id % 7 % 2) + 1) as direction", "id as claim_ord")
    got = X.linked_claims(news, claims)
    best = {(r["topic"], r["metric_name"]): r["m_claim_id"] for r in got.select("topic", "metric_name", "m_claim_id").distinct().collect()}
    want = {}
    for topic, metric in ((t, m) for t in ("cost", "margin", "risk") for m in "ab"):
        first = lambda i: (-(3 * (("cost", "margin", "risk")[i % 3] == topic) + 2 * (("b", "c")[i % 2] == metric) + 4 * (i % 7 % 2 == 0)), i)
        near = [i for i in range(2000) if ("cost", "margin", "risk")[i % 3] == topic or (topic != "risk" and i % 3 < 2)]
        want[topic, metric] = min(near, key=first)
    assert got.count() == n and best == want


def test_articles_meet_one_row_and_kinds_are_not_joined_back(spark):
    """Rows that go through a shuffle: an article once to its company, kinds of claims once to each block."""
    news = spark.createDataFrame([(1, "A", date(2020, 3, 1))], "news_claim_id int, ticker string, publish_date date")
    reports = spark.createDataFrame([(7, "A", 2019, 1), (8, "A", 2021, 0)], "mda_document_id int, ticker string, report_year int, mda_ord int")
    best = X.best_documents(news, reports)
    assert best._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [r["mda_document_id"] for r in best.collect()] == [7]
    labels = "topic string, claim_type string, metric_name string, direction string, "
    claims = spark.createDataFrame([("cost", "risk", "x", "up", 1, 7, 1), ("other", "outlook", "y", "up", 2, 7, 0)], labels + "claim_id int, mda_document_id int, claim_ord int")
    told = spark.createDataFrame([("margin", "outlook", "y", "up", 1, 7)], labels + "news_claim_id int, mda_document_id int")
    got = X.linked_claims(told, claims)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    # a close topic goes before any score
    assert [r["m_claim_id"] for r in got.collect()] == [1]
