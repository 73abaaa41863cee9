"""Figures and auditors in the pages of annual reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.numbers import number_or


def filled_from_next_year(df: DataFrame, code: str, year: str, value: str, comparative: str) -> DataFrame:
    """Missing values taken from the comparative figure of the following year (exactly one later, gaps do not count)."""
    later = df.select(F.col(code).alias("code_"), (F.col(year) - 1).alias("year_"), F.col(comparative).alias("next_"))
    j = df.join(later, (F.col(code) == F.col("code_")) & (F.col(year) == F.col("year_")), "left")
    source = F.when(F.col(value).isNotNull(), "own").when(F.col("next_").isNotNull(), "next_year").otherwise("missing")
    return j.select(code, year, F.coalesce(value, "next_").alias(value), source.alias("filled_from"))


def pages(docs: DataFrame, *, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """document, page (from 0), line (from 0) and text of every line; pages end at form feeds."""
    p = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(text_col, "\f")).alias("page", "body"))
    return p.select("document_id", "page", F.posexplode(F.split("body", "\n")).alias("line", "text"))


def numbers_in(line: Column) -> Column:
    """Numbers of a line; brackets make them negative; lone years are left out."""
    found = F.regexp_extract_all(line, F.lit(r"(\(?\d[\d,]*(?:\.\d+)?\)?)"), F.lit(1))
    plain = F.filter(found, lambda x: ~x.rlike(r"^(19|20)\d{2}$"))
    return F.transform(plain, lambda x: F.when(x.startswith("("), -1.0).otherwise(1.0) * F.regexp_replace(x, "[(),]", "").try_cast("double"))


def labelled_figure(lines: DataFrame, label: str, *, reach: int = 1) -> DataFrame:
    """document, value, page: the first number after a label, on its line or joined with the next `reach` ones; the earliest page and line wins."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id", "page").orderBy("line")
    joined = F.col("text")
    for k in range(1, reach + 1):
        joined = F.concat(joined, F.lit(" "), F.coalesce(F.lead("text", k).over(w), F.lit("")))
    rows = lines.withColumn("joined_", joined).where(F.lower("text").contains(label.lower()))
    tail = F.regexp_replace("joined_", rf"(?is)^.*?\Q{label}\E", "")
    found = rows.select("document_id", "page", "line", numbers_in(tail).alias("n_")).where(F.size("n_") > 0)
    best = found.groupBy("document_id").agg(F.min_by(F.struct(F.col("n_")[0].alias("value"), "page"), F.struct("page", "line")).alias("b_"))
    return best.select("document_id", "b_.*")


def unit_scale(text: Column) -> Column:
    """What a statement's figures are multiplied by: thousands or millions if it says so."""
    low = F.lower(text)
    return F.when(low.rlike(r"rm\s*'?\s*000|in thousands"), 1e3).when(low.rlike(r"rm\s*million|in millions"), 1e6).otherwise(1.0)


def majority(df: DataFrame, group: str, value: str, *, lead: float = 2.0) -> DataFrame:
    """group, value, votes of the most frequent value where it has at least `lead` times the votes of the next; else no row. Counts alone are compared: a group may have any number of values."""
    votes = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("votes"))
    first = votes.groupBy(F.col(group).alias("g_")).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v"))).alias("best_"))
    both = votes.join(first, F.col(group).eqNullSafe(F.col("g_")))
    told = both.groupBy(group).agg(F.first("best_").alias("best_"), F.coalesce(F.max(F.when(F.col(value) != F.col("best_.v"), F.col("votes"))), F.lit(0)).alias("next_"))
    return told.where(-F.col("best_.n") >= lead * F.col("next_")).select(group, F.col("best_.v").alias(value), (-F.col("best_.n")).alias("votes"))


def auditor(docs: DataFrame, firms: list[str], *, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """document, auditor, found_by: a firm near "independent auditors' report", else after "auditors:", else the clear majority of mentions."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[‘’]", "'")
    any_firm = "(?i)(" + "|".join(rf"\Q{f}\E" for f in firms) + ")"
    near = F.regexp_extract(text, rf"(?is)independent auditors?'? report.{{0,400}}?{any_firm}", 1)
    label = F.regexp_extract(text, rf"(?is)auditors?\s*:\s*.{{0,60}}?{any_firm}", 1)
    staged = docs.select(F.col(id_col).alias("document_id"), near.alias("near_"), label.alias("label_"), F.regexp_extract_all(text, F.lit(any_firm), F.lit(1)).alias("all_"))
    votes = majority(staged.select("document_id", F.explode("all_").alias("v_")).withColumn("v_", F.lower("v_")), "document_id", "v_")
    j = staged.join(votes, "document_id", "left")
    pick = F.when(F.col("near_") != "", F.col("near_")).when(F.col("label_") != "", F.col("label_")).otherwise(F.col("v_"))
    how = F.when(F.col("near_") != "", "report").when(F.col("label_") != "", "label").when(F.col("v_").isNotNull(), "majority")
    return j.select("document_id", F.lower(pick).alias("auditor"), how.alias("found_by"))


def warnings(df: DataFrame) -> DataFrame:
    """code, warning: a company with several auditors, and one whose profit grows tenfold or turns from year to year."""
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("year")
    several = df.groupBy("code").agg(F.count_distinct("auditor").alias("n")).where("n > 1").select("code", F.lit("auditor_changed").alias("warning"))
    p = df.withColumn("before_", F.lag(number_or(F.col("profit"), 0.0)).over(w)).withColumn("now_", number_or(F.col("profit"), 0.0))
    swing = p.where("before_ <> 0 and (abs(now_ / before_) > 10 or now_ * before_ < 0)").select("code", F.lit("profit_swing").alias("warning")).distinct()
    return several.unionByName(swing)
