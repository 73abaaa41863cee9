"""Queries that write a table by one of the sinks and read it back by one of the sources, and queries on values written out of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorewright.functions import dates, text as X
from scorewright.operators import fundamentals as B
from scorewright.operators import jsonfix as J
from scorewright.operators import registry as G
from scorewright.plans.ratings import table
from scorewright.sources import readers, sinks
from scorewright.sources.tables import shared_folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_orderdate::VARCHAR AS day, '' AS absent FROM (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders)")
def csv_round_trip(spark, sf_dir):
    """Orders written as CSV and read back: columns by name, one that the files lack comes empty, synonyms are mapped."""
    path = _place(spark, "csv")
    o = table(spark, sf_dir, "orders").withColumn("Order Date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    sinks.write_csv(o, path, ["o_orderkey", "o_orderpriority", "Order Date"])
    assert readers.missing_columns(spark, path, ["o_orderkey", "absent"]) == ["absent"]
    got = readers.csv(spark, path, ["o_orderkey", "o_orderpriority", "Order Date", "absent"])
    return readers.mapped(got, {"o_orderkey": [], "o_orderpriority": [], "day": ["date", "order date"], "absent": []})


@query("SELECT event_id, user_id, event_type FROM events")
def json_lines_round_trip(spark, sf_dir):
    """Events appended to JSON lines in two goes and read back."""
    path, e = f"{_place(spark, 'json')}.jsonl", table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in (0, 1):
        sinks.append_json(e.where(F.col("event_id") % 2 == part), path)
    return readers.records(spark, path, e.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


@query("SELECT n_nationkey, n_regionkey, n_name FROM nation")
def json_wrapped_records(spark, sf_dir):
    """Nations in one file a region, which holds a list or a wrapped list, read back in one go."""
    path, n = _place(spark, "wrapped"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    lists = n.groupBy(F.col("n_regionkey").alias("g")).agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("l"))
    value = F.when(F.col("g") % 2 == 0, F.col("l")).otherwise(F.concat(F.lit('{"items": '), "l", F.lit("}"))).alias("value")
    lists.select(value, "g").write.partitionBy("g").text(path)
    return readers.records(spark, path, "n_nationkey int, n_regionkey int, n_name string")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def manifest_upsert(spark, sf_dir):
    """Rows of an old manifest whose key a new one has not, and all of the new one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return sinks.without_keys(o.where("k % 2 = 0").withColumn("version", F.lit("old")), o.where("k % 3 = 0").withColumn("version", F.lit("new")), ["k"])


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1) SELECT kind, n FROM (SELECT 'table' AS kind, count(*) AS n FROM m UNION ALL SELECT 'records', count(*) FROM m WHERE open) WHERE n > 0""")
def discovered_kinds(spark, sf_dir):
    """Kinds of the files below a folder, without those of an excluded path: a table of orders a month, records of the months with pending orders, and an archive that is left out."""
    path, o = _place(spark, "found"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).repartition("month")
    o.write.partitionBy("month").csv(f"{path}/a")
    pending = o.where("o_orderstatus = 'P'")
    pending.write.partitionBy("month").json(f"{path}/b")
    pending.write.partitionBy("month").json(f"{path}/archive/c")
    return readers.discovered(spark, path, ["/archive/"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) AS y, month(o_orderdate) % 3 = 0 AS redone FROM orders)
SELECT month, CASE WHEN y < 1994 THEN 'removed' WHEN y > 1996 THEN 'added' ELSE 'altered' END AS change FROM f WHERE y < 1994 OR y > 1996 OR redone""")
def checksum_changes(spark, sf_dir):
    """Orders kept in a file a month: which files a second version removes, adds or alters, by their checksums."""
    path, o = _place(spark, "sums"), table(spark, sf_dir, "orders")
    month, redone = F.date_format("o_orderdate", "yyyy-MM"), F.month("o_orderdate") % 3 == 0
    line = lambda more: F.concat_ws(",", F.col("o_orderkey"), F.col("o_custkey"), F.when(redone, more))
    found = []
    for name, years, more in (("before", F.year("o_orderdate") <= 1996, "first"), ("after", F.year("o_orderdate") >= 1994, "second")):
        o.where(years).select(line(more).alias("value"), month.alias("month")).repartition("month").sortWithinPartitions("month", "value").write.partitionBy("month").text(f"{path}/{name}")
        found.append(readers.checksums(spark, f"{path}/{name}").withColumn("path", F.regexp_extract("path", r"/month=([\d-]+)/", 1)))
    return readers.changed(*found).select(F.col("path").alias("month"), "change")


@query("SELECT count(*) AS rows, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'problem_empty' END AS status FROM orders UNION ALL SELECT 0, 'problem_empty' UNION ALL SELECT count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'allowed_empty' END FROM orders WHERE o_totalprice < 1000")
def empty_output_audit(spark, sf_dir):
    """Outputs of the orders: all of them, those without a customer, which may not be empty, and the cheapest, which may."""
    path, o = _place(spark, "audit"), table(spark, sf_dir, "orders")
    o.write.parquet(f"{path}/full")
    o.where("o_custkey is null").write.parquet(f"{path}/none")
    o.where("o_totalprice < 1000").write.parquet(f"{path}/optional")
    return sinks.empty_outputs(spark, {f"{path}/full": False, f"{path}/none": False, f"{path}/optional": True}).drop("path")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def preferred_source(spark, sf_dir):
    """The first of several sources that has accepted rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return readers.first_with_rows([o.where("o_custkey < 0"), o.where("o_orderkey % 2 = 1"), o], F.col("o_custkey") >= 0)


_SPELLINGS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy", "'seen on' yyyy.M.d", "'about' yyyy")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_SPELLINGS)} = 5 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate, '%Y') AS year FROM orders")
def dates_of_spellings(spark, sf_dir):
    """Dates of orders written in several ways, read back as ISO dates, and their years."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_timestamp("o_orderdate"))
    spelt = F.element_at(F.array(*[F.date_format("d", f) for f in _SPELLINGS]), (F.col("o_orderkey") % len(_SPELLINGS) + 1).cast("int"))
    return o.select("o_orderkey", dates.iso_date(spelt).alias("day"), dates.year_of(F.date_format("d", "yyyy-MM")).alias("year"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'First ' || c_custkey || '. Second ' || c_nationkey || '.' ELSE 'One ' || c_custkey || '. Two ' || c_nationkey || '.' END AS lead FROM customer")
def leads(spark, sf_dir):
    """The first two paragraphs of a text, or sentences where it has but one paragraph."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    paragraphs = F.concat(F.lit("First "), k, F.lit(".\n\nSecond "), n, F.lit(".\n \nThird."))
    sentences = F.concat(F.lit("One "), k, F.lit(". Two "), n, F.lit(". Three."))
    return table(spark, sf_dir, "customer").select("c_custkey", X.lead(F.when(F.col("c_custkey") % 2 == 0, paragraphs).otherwise(sentences)).alias("lead"))


@query("WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, o_orderpriority) AS k, lead(votes) OVER (PARTITION BY o_custkey ORDER BY votes DESC, o_orderpriority) AS next FROM v) SELECT o_custkey, o_orderpriority, votes FROM r WHERE k = 1 AND (next IS NULL OR votes >= 2 * next)")
def priority_majorities(spark, sf_dir):
    return B.majority(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


FIRMS = ("north & partners", "south llp", "east auditors")
_FIRM_SQL = f"list_extract({list(FIRMS)}, (c_custkey % {len(FIRMS)} + 1)::BIGINT)"


@query(f"SELECT c_custkey AS document_id, {_FIRM_SQL} AS auditor, list_extract(['report', 'label', 'majority'], (c_nationkey % 3 + 1)::BIGINT) AS found_by FROM customer")
def auditors_found(spark, sf_dir):
    """Auditors named in a report's heading, after a label, or by a clear majority of mentions."""
    at = lambda c, xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.col(c) % len(xs) + 1).cast("int"))
    firm, other = at("c_custkey", FIRMS), at("c_custkey", FIRMS[1:] + FIRMS[:1])
    text = at("c_nationkey", [F.concat(F.lit("Independent Auditors’ Report\nto the members, by "), firm, F.lit(". "), other), F.concat(F.lit("Secretary: "), other, F.lit("\n\nAuditors: Messrs "), firm), F.concat_ws(" and ", firm, other, firm)])
    return B.auditor(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), text.alias("text")), list(FIRMS))


@query("""SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 9 = 8 THEN 'missing_score' WHEN event_id % 9 NOT BETWEEN 1 AND 5 THEN 'score_out_of_range' END,
CASE WHEN event_id % 4 = 0 THEN 'missing_evidence' WHEN event_id % 4 = 1 THEN 'evidence_not_a_locator' END, CASE WHEN event_id % 5 = 0 THEN 'missing_reason' WHEN event_id % 5 = 1 THEN 'reason_too_long' END, CASE WHEN event_id % 7 = 0 THEN 'nested_value' END], lambda x: x IS NOT NULL)), ';') AS issues FROM events""")
def payload_issue_lists(spark, sf_dir):
    """Issues of one-dimension payloads written out of the events."""
    k = F.col("event_id")
    score = F.when(k % 9 == 8, "").otherwise(F.concat(F.lit('"score": '), (k % 9).cast("string"), F.lit(", ")))
    evidence = F.when(k % 4 == 0, "").when(k % 4 == 1, "page 3").otherwise("[MDA_P012]")
    reason = F.when(k % 5 == 0, "").when(k % 5 == 1, F.repeat(F.lit("y"), 241)).otherwise("as stated")
    more = F.when(k % 7 == 0, ', "x": [1]').otherwise("")
    payload = F.concat(F.lit("{"), score, F.lit('"evidence": "'), evidence, F.lit('", "reason": "'), reason, F.lit('"'), more, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(J.payload_issues(payload), ";").alias("issues"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 6 THEN 'raw_score_invalid' WHEN o_orderkey % 7 NOT BETWEEN 1 AND 5 THEN 'raw_score_out_of_range' END, CASE WHEN o_orderkey % 3 = 0 THEN 'evidence_locator_invalid' END,
CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 2 = 0 THEN 'ar02_external_verification_claim' END, CASE WHEN o_orderkey % 11 = 1 THEN 'scope_violation' END, CASE WHEN o_orderkey % 5 = 0 THEN 'empty_evidence' END,
CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 IN (4, 5) AND o_custkey % 2 = 1 THEN 'numeric_check_conflict' END, CASE WHEN o_custkey % 4 = 0 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ';') AS issues FROM orders""")
def rating_issue_lists(spark, sf_dir):
    """Issues of ratings written out of the orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(k % 7 == 6, "n/a").otherwise((k % 7).cast("string"))
    remarks = F.when(k % 11 == 0, "Matches the audited financial statements").when(k % 11 == 1, "See the corporate governance part").otherwise("")
    issues = G.rating_issues(F.when(k % 2 == 0, "AR02").otherwise("AR01"), raw, F.when(k % 5 == 0, " ").otherwise("[MDA_P001]"), k % 3 != 0, F.lit("said"), F.when(c % 4 == 0, "Low").otherwise("high"), remarks, c % 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(issues, ";").alias("issues"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 10 WHEN c_custkey % 6 = 0 THEN 99 END::INTEGER AS filled, CASE WHEN c_custkey % 6 = 0 THEN 99 WHEN c_custkey % 4 = 0 THEN c_custkey % 10 END::INTEGER AS overridden FROM customer")
def constant_overrides(spark, sf_dir):
    """A column filled, and one overridden, from a table of fixes."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, (F.col("c_custkey") % 10).cast("int")).alias("v"))
    fixes = c.where("c_custkey % 6 = 0").select("c_custkey", F.lit(99).alias("v"))
    filled = G.with_constants(c, fixes, "c_custkey", "v", only_missing=True).withColumnRenamed("v", "filled")
    return filled.join(G.with_constants(c, fixes, "c_custkey", "v", only_missing=False).withColumnRenamed("v", "overridden"), "c_custkey")


@query("WITH m AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem) SELECT least(19, floor((l_quantity - lo) / ((hi - lo) / 20)))::INTEGER AS bin, count(*) AS n FROM lineitem, m GROUP BY 1")
def quantity_histogram(spark, sf_dir):
    return sinks.histogram(table(spark, sf_dir, "lineitem"), "l_quantity").select("bin", "n")
