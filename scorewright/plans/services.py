"""Queries on what a model service answers, and on archives and sheets that are packed out of the tables and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from scorewright.operators import scorer
from scorewright.plans.ratings import table
from scorewright.plans.texts import _TOKENS_SQL
from scorewright.sources import readers
from scorewright.sources.tables import keeper

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def faulty_service():
    """A stand-in for a model that goes wrong in one of eight ways, by the number that the prompt names."""

    def answer(prompt: str, attempt: int) -> str:
        n = int(prompt.split(None, 2)[1])
        good = f'{{"score": {1 + n % 5}, "evidence": "[NEWS_P001]", "reason": "as stated"}}'
        kind = n % 8
        if kind == 3 or (kind == 2 and attempt == 1):
            raise TimeoutError("timed out")
        if kind == 1:
            return f"```json\n{good}\n```"
        if kind == 4 and attempt == 1:
            return good.replace(f'"score": {1 + n % 5}', '"score": 9')
        if kind == 5:
            return good[:-1]
        if kind == 6:
            return f"<think>hm</think>{good}" if attempt == 3 else "sorry"
        return good.replace("P001", "P007") if kind == 7 else good

    return answer


_PROMPT_SQL = "('Document ' || doc_id || chr(10) || text)"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, {_TOKENS_SQL.format(t=_PROMPT_SQL)} AS tokens FROM documents)
SELECT doc_id, CASE WHEN tokens <= 3776 AND k IN (0, 1, 4, 6) THEN 'success' ELSE 'failed' END AS status, CASE WHEN tokens <= 3776 AND k IN (0, 1, 4, 6) THEN 1 + doc_id % 5 END::INTEGER AS score, CASE WHEN tokens > 3776 THEN 0 WHEN k IN (0, 1) THEN 1 WHEN k IN (2, 4) THEN 2 ELSE 3 END::INTEGER AS attempts,
CASE WHEN tokens > 3776 OR k = 3 THEN 'not_attempted' WHEN k = 5 THEN 'parse_failed' ELSE 'parsed' END AS parse_status, CASE WHEN tokens > 3776 OR k IN (3, 5, 7) THEN 'invalid' ELSE 'valid' END AS schema_status,
CASE WHEN tokens > 3776 THEN 'context_budget_failed' WHEN k IN (2, 3) THEN 'request_failed' WHEN k IN (5, 7) THEN 'manual_required' ELSE '' END AS error_type,
CASE WHEN tokens > 3776 THEN 'tokens ' || tokens || ' over 3776' WHEN k IN (2, 3) THEN 'timed out' WHEN k = 5 THEN 'json_parse_failed' WHEN k = 7 THEN 'evidence_locator_not_found' ELSE '' END AS error_message FROM d""")
def scored_documents(spark, sf_dir):
    """Every document scored by a service that fails in eight ways: what each came to, after how many calls, and why."""
    d = table(spark, sf_dir, "documents")
    tasks = d.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("prompt"), F.concat(F.lit("[NEWS_P001] "), "text").alias("text"), F.lit("NEWS").alias("prefix"))
    return scorer.scored(tasks, faulty_service(), id_cols=["doc_id"]).drop("evidence", "reason")


#: Customers of a member, and members of an archive.
MEMBER_ROWS, MEMBERS = 100, 4


def packed_customers(spark, sf_dir):
    """path, content: customers as CSV in zip archives of four members; in every other archive the third member is damaged."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, part in rows.groupby("m"):
                z.writestr(f"part{m}.csv", part.sort_values("c_custkey")[["c_custkey", "c_name", "c_mktsegment"]].to_csv(index=False))
            hurt = next((i for i in z.infolist() if i.filename == "part2.csv"), None)
        content = bytearray(out.getvalue())
        if hurt is not None and key[0] % 2 == 0:
            content[hurt.header_offset + 30 + len(hurt.filename) + hurt.compress_size // 2] ^= 0xFF
        return pd.DataFrame({"path": [f"customers{key[0]}.zip"], "content": [bytes(content)]})

    nth = F.floor(F.col("c_custkey") / MEMBER_ROWS)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", (nth % MEMBERS).alias("m"), F.floor(nth / MEMBERS).alias("a"))
    return c.groupBy("a").applyInPandas(pack, "path string, content binary")


@query(f"""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey // {MEMBER_ROWS} % {MEMBERS} AS m, c_custkey // {MEMBER_ROWS * MEMBERS} AS a FROM customer)
SELECT 'customers' || a || '.zip' AS archive, 'part' || m || '.csv' AS member, CASE WHEN m = 2 AND a % 2 = 0 THEN 0 ELSE count(*) END AS n_rows, CASE WHEN m = 2 AND a % 2 = 0 THEN NULL ELSE sum(c_custkey)::BIGINT END AS keys, CASE WHEN m = 2 AND a % 2 = 0 THEN NULL ELSE count(DISTINCT c_mktsegment) END AS segments, CASE WHEN m = 2 AND a % 2 = 0 THEN 'damaged_member' ELSE '' END AS error FROM c GROUP BY a, m""")
def archive_round_trip(spark, sf_dir):
    """Customers packed into archives and read back member by member: what each gave, and which are damaged."""
    keep = keeper(spark, "archives")
    members = keep(readers.archive_members(keep(packed_customers(spark, sf_dir))))
    rows = readers.member_rows(members, ["c_custkey", "c_name", "c_mktsegment"])
    by = rows.groupBy("archive", "member").agg(F.count_if(F.col("error").isNull()).alias("n_rows"), F.sum(F.col("c_custkey").try_cast("long")).alias("keys"), F.count_distinct("c_mktsegment").alias("s_"), F.coalesce(F.max(F.substring_index("error", ":", 1)), F.lit("")).alias("error"))
    return by.select("archive", "member", "n_rows", "keys", F.when(F.col("error") == "", F.col("s_")).alias("segments"), "error")
