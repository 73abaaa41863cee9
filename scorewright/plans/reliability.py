"""Queries on rank stability, repeated runs, agreement and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions.numbers import difference_flag, judgement, pearson_of, same_everywhere
from scorewright.operators import ranking as K
from scorewright.operators import scoring as S
from scorewright.operators import stats as T
from scorewright.plans import ratings as R
from scorewright.plans.ratings import CODES, SQL_COMPANIES, SQL_SCORES, SQL_WIDE, WEIGHTS, sql_total

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Alternative weights of the five dimensions.
SCHEMES = {"base": WEIGHTS, "equal": dict.fromkeys(CODES, 0.2), "facts": dict(zip(CODES, (0.10, 0.40, 0.25, 0.15, 0.10), strict=True))}
_NAMES = list(SCHEMES)
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]


def _once(weights) -> str:
    return "round(" + " + ".join(f"100.0::DOUBLE * ({c} - 1) / 4.0::DOUBLE * {w}::DOUBLE" for c, w in weights.items()) + ", 6)"


_SCHEME_SQL = SQL_WIDE + ", schemes AS (SELECT document_id, " + ", ".join(f"{_once(w)} AS {n}" for n, w in SCHEMES.items()) + " FROM complete)"


def _schemes(spark, sf_dir):
    wide = S.complete(R.wide(spark, sf_dir), CODES)
    return wide.select("document_id", *[S.total_once(w).alias(n) for n, w in SCHEMES.items()])


def sql_pearson(x: str, y: str, constant: str = "0.0::DOUBLE", least: int = 2) -> str:
    flat = f"stddev_pop({x}) < 1e-12 OR stddev_pop({y}) < 1e-12"
    return f"CASE WHEN count(*) < {least} THEN 0.0::DOUBLE WHEN {flat} THEN {constant} ELSE round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))), 6) END"


@query(f"WITH {_SCHEME_SQL} SELECT document_id, base, equal, facts, " + ", ".join(f"rank() OVER (ORDER BY {n} DESC) AS rank_{n}" for n in _NAMES) + ", round(greatest(base, equal, facts) - least(base, equal, facts), 6) AS score_range FROM schemes")
def weight_scheme_scores_ranks(spark, sf_dir):
    out = _schemes(spark, sf_dir)
    for n in _NAMES:
        out = K.competition_rank(out, n, f"rank_{n}")
    return out.withColumn("score_range", F.round(F.greatest(*_NAMES) - F.least(*_NAMES), 6))


@query(f"WITH {_SCHEME_SQL}, r AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {n} DESC) AS r_{n}" for n in _NAMES) + " FROM schemes) SELECT document_id, greatest(abs(r_base - r_equal), abs(r_base - r_facts), abs(r_equal - r_facts)) AS max_rank_change, count(*) OVER () AS documents FROM r WHERE greatest(abs(r_base - r_equal), abs(r_base - r_facts), abs(r_equal - r_facts)) > 10")
def rank_changes(spark, sf_dir):
    out = _schemes(spark, sf_dir)
    for n in _NAMES:
        out = K.competition_rank(out, n, f"r_{n}")
    moved = out.withColumn("max_rank_change", F.greatest(*[F.abs(F.col(f"r_{a}") - F.col(f"r_{b}")) for a, b in _PAIRS])).where("max_rank_change > 10").select("document_id", "max_rank_change")
    return moved.join(F.broadcast(moved.agg(F.count("*").alias("documents"))), F.lit(True))


@query(f"WITH {_SCHEME_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS left_scheme, '{b}' AS right_scheme, {sql_pearson(a, b, f'CASE WHEN bool_and({a} = {b}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} AS pearson FROM schemes" for a, b in _PAIRS))
def scheme_pairwise_pearson(spark, sf_dir):
    row = _schemes(spark, sf_dir).agg(*[pearson_of(a, b, constant=same_everywhere(a, b)).alias(f"{a}_{b}") for a, b in _PAIRS])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left_scheme"), F.lit(b).alias("right_scheme"), F.col(f"{a}_{b}").alias("pearson")) for a, b in _PAIRS])))


@query(f"WITH {_SCHEME_SQL}, r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {n} DESC)::DOUBLE AS {n}" for n in _NAMES) + " FROM schemes) " + " UNION ALL ".join(f"SELECT '{a}' AS left_scheme, '{b}' AS right_scheme, {sql_pearson(a, b)} AS spearman, CASE WHEN {sql_pearson(a, b)} >= 0.9 THEN 'stable' WHEN {sql_pearson(a, b)} >= 0.8 THEN 'moderate' ELSE 'unstable' END AS judgement FROM r" for a, b in _PAIRS))
def scheme_pairwise_spearman(spark, sf_dir):
    """On competition ranks: ties share the least place."""
    out = _schemes(spark, sf_dir)
    for n in _NAMES:
        out = K.competition_rank(out, n, f"r_{n}")
    row = out.agg(*[pearson_of(f"r_{a}", f"r_{b}").alias(f"{a}_{b}") for a, b in _PAIRS])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left_scheme"), F.lit(b).alias("right_scheme"), F.col(f"{a}_{b}").alias("spearman"), judgement(F.col(f"{a}_{b}"), 0.9, 0.8).alias("judgement")) for a, b in _PAIRS])))


@query(f"WITH {_SCHEME_SQL}, r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE AS {n}" for n in _NAMES) + f" FROM schemes) SELECT {sql_pearson('base', 'equal')} AS spearman_equal, {sql_pearson('base', 'facts')} AS spearman_facts, least({sql_pearson('base', 'equal')}, {sql_pearson('base', 'facts')}) AS least_spearman FROM r")
def rank_stability_summary(spark, sf_dir):
    """On average ranks."""
    out = _schemes(spark, sf_dir)
    for n in _NAMES:
        out = K.average_rank(out, n, f"r_{n}")
    return out.agg(pearson_of("r_base", "r_equal").alias("spearman_equal"), pearson_of("r_base", "r_facts").alias("spearman_facts")).withColumn("least_spearman", F.least("spearman_equal", "spearman_facts"))


def _edge_sql(size: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{n}' AS scheme, document_id, {n} AS v FROM schemes" for n in _NAMES)
    both = "JOIN f b ON a.document_id = b.document_id AND a.scheme < b.scheme"
    return f"""WITH {_SCHEME_SQL}, l AS ({long}), k AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY v DESC, document_id DESC) AS t, row_number() OVER (PARTITION BY scheme ORDER BY v, document_id) AS b, greatest(1, {size}) AS z FROM (SELECT *, count(*) OVER (PARTITION BY scheme) AS n FROM l)),
f AS (SELECT scheme, document_id, t <= z AS top, b <= z AS bottom, z FROM k)
SELECT a.scheme AS left_scheme, b.scheme AS right_scheme, max(a.z)::BIGINT AS edge_size, round(count(*) FILTER (a.top AND b.top)::DOUBLE / max(a.z), 6) AS top_overlap, round(count(*) FILTER (a.bottom AND b.bottom)::DOUBLE / max(a.z), 6) AS bottom_overlap FROM f a {both} GROUP BY 1, 2"""


def _edge_overlap(spark, sf_dir, rounding):
    long = S.unpivoted(_schemes(spark, sf_dir), _NAMES, ids=["document_id"], code_col="scheme", score_col="v")
    flags = K.edge_flags(long, "v", "document_id", groups=["scheme"], rounding=rounding)
    a, b = flags.alias("a"), flags.alias("b")
    both = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.scheme") < F.col("b.scheme")))
    size = F.max("a.edge_size")
    return both.groupBy(F.col("a.scheme").alias("left_scheme"), F.col("b.scheme").alias("right_scheme")).agg(size.alias("edge_size"), F.round(F.count_if(F.col("a.in_top") & F.col("b.in_top")) / size, 6).alias("top_overlap"), F.round(F.count_if(F.col("a.in_bottom") & F.col("b.in_bottom")) / size, 6).alias("bottom_overlap"))


@query(_edge_sql("ceil(n * 0.2::DOUBLE)"))
def scheme_edge_overlap_ceil(spark, sf_dir):
    return _edge_overlap(spark, sf_dir, "ceil")


@query(_edge_sql("round_even(n * 0.2::DOUBLE, 0)"))
def scheme_edge_overlap_round(spark, sf_dir):
    return _edge_overlap(spark, sf_dir, "even")


_CELLS = " UNION ALL ".join(f"SELECT '{a}' AS left_code, '{b}' AS right_code, " + ("max(1.0::DOUBLE)" if a == b else sql_pearson(a, b)) + f" AS correlation FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in CODES for b in CODES)


@query(f"WITH {SQL_WIDE} {_CELLS}")
def dimension_correlation_matrix(spark, sf_dir):
    return T.wide_correlations(R.wide(spark, sf_dir), CODES)


@query(f"WITH {SQL_WIDE}, m AS ({_CELLS}) SELECT * FROM m WHERE left_code < right_code AND correlation > 0.0")
def high_correlation_pairs(spark, sf_dir):
    return T.high_pairs(dimension_correlation_matrix(spark, sf_dir), 0.0)


@query(f"WITH {_SCHEME_SQL} SELECT document_id, round(greatest(base, equal, facts) - least(base, equal, facts), 6) AS score_range, base FROM schemes ORDER BY score_range DESC, base DESC, document_id LIMIT 10")
def sensitive_documents_top10(spark, sf_dir):
    s = _schemes(spark, sf_dir).withColumn("score_range", F.round(F.greatest(*_NAMES) - F.least(*_NAMES), 6))
    return s.select("document_id", "score_range", "base").orderBy(F.desc("score_range"), F.desc("base"), "document_id").limit(10)


_REDO = {c: f"(1 + ({c} - 1 + CASE WHEN (document_id + {i}) % 7 = 0 THEN 1 WHEN (document_id + {i}) % 11 = 0 THEN 2 ELSE 0 END) % 5)::INTEGER" for i, c in enumerate(CODES, 1)}
_RUNS_SQL = SQL_SCORES + ", redo AS (SELECT document_id, " + ", ".join(f"{e} AS {c}" for c, e in _REDO.items()) + f" FROM complete), pair AS (SELECT a.document_id, a.total_score_100 AS t1, {sql_total({f'b.{c}': w for c, w in WEIGHTS.items()})} AS t2, greatest(" + ", ".join(f"abs(a.{c} - b.{c})" for c in CODES) + ") AS max_dim_diff, " + " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 1 ELSE 0 END" for c in CODES) + " AS same, " + " + ".join(f"CASE WHEN abs(a.{c} - b.{c}) <= 1 THEN 1 ELSE 0 END" for c in CODES) + " AS near, a.D1 AS x1, b.D1 AS y1 FROM scores a JOIN redo b USING (document_id))"


def _pair(spark, sf_dir):
    """Each complete document's ratings and a second run's, derived from them."""
    one = R.scores(spark, sf_dir)
    redo = [(1 + (F.col(c) - 1 + F.when((F.col("document_id") + i) % 7 == 0, 1).when((F.col("document_id") + i) % 11 == 0, 2).otherwise(0)) % 5).cast("int").alias(f"b_{c}") for i, c in enumerate(CODES, 1)]
    both = one.select("document_id", *CODES, F.col("total_score_100").alias("t1"), *redo)
    diffs = [F.abs(F.col(c) - F.col(f"b_{c}")) for c in CODES]
    t2 = S.total_of({f"b_{c}": w for c, w in WEIGHTS.items()})
    return both.select("*", t2.alias("t2"), F.greatest(*diffs).alias("max_dim_diff"), sum([(d == 0).cast("int") for d in diffs[1:]], (diffs[0] == 0).cast("int")).alias("same"), sum([(d <= 1).cast("int") for d in diffs[1:]], (diffs[0] <= 1).cast("int")).alias("near"))


@query(f"WITH {_RUNS_SQL} SELECT document_id, t1, t2, round(abs(t1 - t2), 6) AS total_diff, max_dim_diff, CASE WHEN abs(t1 - t2) > 10 THEN 'unstable' WHEN abs(t1 - t2) > 5 THEN 'moderate' ELSE 'stable' END AS flag, max_dim_diff < 2 AND abs(t1 - t2) <= 5 AS passed FROM pair")
def repeat_run_comparison(spark, sf_dir):
    d = F.abs(F.col("t1") - F.col("t2"))
    return _pair(spark, sf_dir).select("document_id", "t1", "t2", F.round(d, 6).alias("total_diff"), "max_dim_diff", difference_flag(d, (5, "moderate"), (10, "unstable")).alias("flag"), ((F.col("max_dim_diff") < 2) & (d <= 5)).alias("passed"))


@query(f"WITH {_RUNS_SQL} SELECT count(*) AS documents, round(sum(same) / (5.0::DOUBLE * count(*)), 6) AS exact_agreement, round(sum(near) / (5.0::DOUBLE * count(*)), 6) AS within_one, round(avg(CASE WHEN max_dim_diff < 2 AND abs(t1 - t2) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pass_rate, round(avg(abs(t1 - t2)), 6) AS mean_abs_diff FROM pair")
def repeatability_metrics(spark, sf_dir):
    d = F.abs(F.col("t1") - F.col("t2"))
    ok = ((F.col("max_dim_diff") < 2) & (d <= 5)).cast("double")
    n = 5.0 * F.count("*")
    return _pair(spark, sf_dir).agg(F.count("*").alias("documents"), F.round(F.sum("same") / n, 6).alias("exact_agreement"), F.round(F.sum("near") / n, 6).alias("within_one"), F.round(F.avg(ok), 6).alias("pass_rate"), F.round(F.avg(d), 6).alias("mean_abs_diff"))


@query(f"WITH {_RUNS_SQL}, m AS (SELECT count(*) AS n, var_pop((t1 + t2) / 2) AS b, sum((t1 - t2) * (t1 - t2) / 2) AS w FROM pair) SELECT n, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (2 * b * n / (n - 1) - w / n) / (2 * b * n / (n - 1) + w / n))), 6) AS icc FROM m")
def repeat_icc(spark, sf_dir):
    return T.icc1(_pair(spark, sf_dir), "t1", "t2")


@query(f"WITH {_RUNS_SQL} SELECT count(*) AS documents, {sql_pearson('t1', 't2')} AS pearson, round(avg(abs(t1 - t2)), 6) AS mean_abs_diff, round(count(*) FILTER (max_dim_diff >= 2)::DOUBLE / count(*), 6) AS material_ratio, count(*) FILTER (max_dim_diff >= 2)::DOUBLE / count(*) >= 0.2 AS full_rescore FROM pair")
def version_comparison(spark, sf_dir):
    material = F.count_if(F.col("max_dim_diff") >= 2) / F.count("*")
    return _pair(spark, sf_dir).agg(F.count("*").alias("documents"), pearson_of("t1", "t2").alias("pearson"), F.round(F.avg(F.abs(F.col("t1") - F.col("t2"))), 6).alias("mean_abs_diff"), F.round(material, 6).alias("material_ratio"), (material >= 0.2).alias("full_rescore"))


@query(f"WITH {_RUNS_SQL}, r AS (SELECT document_id, t1, t2, row_number() OVER (ORDER BY t1 DESC, document_id) AS rank_1, row_number() OVER (ORDER BY t2 DESC, document_id) AS rank_2 FROM pair) SELECT document_id, rank_1, rank_2, abs(rank_1 - rank_2) AS rank_change, CASE WHEN abs(t1 - t2) > 10 THEN 'structure_sensitive' WHEN abs(t1 - t2) > 5 THEN 'moderate' ELSE 'stable' END AS flag FROM r")
def structure_comparison(spark, sf_dir):
    p = K.ordinal_rank(_pair(spark, sf_dir), "t1", [F.col("document_id")], "rank_1")
    p = K.ordinal_rank(p, "t2", [F.col("document_id")], "rank_2")
    return p.select("document_id", "rank_1", "rank_2", F.abs(F.col("rank_1") - F.col("rank_2")).alias("rank_change"), difference_flag(F.abs(F.col("t1") - F.col("t2")), (5, "moderate"), (10, "structure_sensitive")).alias("flag"))


@query(f"""WITH {_RUNS_SQL} SELECT document_id, 'repeat' AS source, 'total_difference' AS metric, round(abs(t1 - t2), 6) AS value FROM pair WHERE abs(t1 - t2) > 10
UNION ALL SELECT document_id, 'repeat', 'dimension_difference', max_dim_diff::DOUBLE FROM pair WHERE max_dim_diff >= 2""")
def volatility_cases(spark, sf_dir):
    from scorewright.operators.gates import cases

    p = _pair(spark, sf_dir)
    d = F.abs(F.col("t1") - F.col("t2"))
    return cases(p, ["document_id"], [("repeat", "total_difference", d > 10, F.round(d, 6)), ("repeat", "dimension_difference", F.col("max_dim_diff") >= 2, F.col("max_dim_diff").cast("double"))])


_RATERS = "r AS (SELECT 1 + 4 * quality AS x, 1 + (length(text) + 4 * quality * (1 + d.doc_id % 3)) % 5 AS y FROM labels JOIN documents d USING (doc_id))"


def _raters(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n"))
    both = R.table(spark, sf_dir, "labels").join(d, "doc_id")
    return both.select((1 + 4 * F.col("quality")).alias("x"), (1 + (F.col("n") + 4 * F.col("quality") * (1 + F.col("doc_id") % 3)) % 5).alias("y"))


@query(f"WITH {_RATERS}, m AS (SELECT count(*) AS n, avg((x - y) * (x - y) / 16.0::DOUBLE) AS s FROM r), a AS (SELECT x, count(*)::DOUBLE AS c FROM r GROUP BY x), b AS (SELECT y, count(*)::DOUBLE AS c FROM r GROUP BY y), e AS (SELECT sum(a.c * b.c * (x - y) * (x - y) / 16.0::DOUBLE) / (any_value(m.n)::DOUBLE * any_value(m.n)::DOUBLE) AS e FROM a, b, m) SELECT n, round(1 - s / e, 6) AS kappa FROM m, e")
def human_agreement_kappa(spark, sf_dir):
    return T.weighted_kappa(_raters(spark, sf_dir), "x", "y")


@query(f"WITH {_RATERS} SELECT count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(avg(CASE WHEN abs(x - y) >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS large_diff_ratio, {sql_pearson('x', 'y')} AS pearson FROM r")
def human_agreement_mae(spark, sf_dir):
    d = F.abs(F.col("x") - F.col("y"))
    return _raters(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mae"), F.round(F.avg((d >= 2).cast("double")), 6).alias("large_diff_ratio"), pearson_of("x", "y").alias("pearson"))


@query(f"WITH {_RUNS_SQL}, m AS (SELECT count(*) AS n, avg(t2 - t1) AS m, stddev_samp(t2 - t1) AS s FROM pair) SELECT n, round(m, 6) AS mean_diff, round(m / (s / sqrt(n::DOUBLE)), 6) AS t_stat FROM m")
def ablation_t_stat(spark, sf_dir):
    return T.paired_t(_pair(spark, sf_dir), "t1", "t2")


@query(f"WITH {_RUNS_SQL}, m AS (SELECT count(*) AS n, avg(CASE WHEN abs(t1 - t2) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM pair) SELECT n, round(p, 6) AS share, round((p - 0.9::DOUBLE) / sqrt(0.9::DOUBLE * (1 - 0.9::DOUBLE) / n), 6) AS z_stat FROM m")
def proportion_z(spark, sf_dir):
    return T.proportion_z(_pair(spark, sf_dir), F.abs(F.col("t1") - F.col("t2")) <= 5)


@query(f"WITH {_RUNS_SQL} SELECT round(avg(t2 - t1), 6) AS mean_diff, round(max(abs(t2 - t1)), 6) AS max_abs_diff, round(avg(CASE WHEN (t1 >= 85) = (t2 >= 85) AND (t1 >= 70) = (t2 >= 70) AND (t1 >= 55) = (t2 >= 55) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS grade_stability, round(sum(same) / (5.0::DOUBLE * count(*)), 6) AS dimension_agreement FROM pair")
def variant_comparison(spark, sf_dir):
    from scorewright.functions.numbers import grade

    same = (grade(F.col("t1")) == grade(F.col("t2"))).cast("double")
    return _pair(spark, sf_dir).agg(F.round(F.avg(F.col("t2") - F.col("t1")), 6).alias("mean_diff"), F.round(F.max(F.abs(F.col("t2") - F.col("t1"))), 6).alias("max_abs_diff"), F.round(F.avg(same), 6).alias("grade_stability"), F.round(F.sum("same") / (5.0 * F.count("*")), 6).alias("dimension_agreement"))


_POP = SQL_COMPANIES + ", b AS (SELECT document_id, total_score_100 AS v, row_number() OVER (ORDER BY total_score_100 DESC, document_id) AS k FROM companies), f AS (SELECT document_id, row_number() OVER (ORDER BY total_score_100 DESC, document_id) AS k FROM companies WHERE segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'))"


@query(f"WITH {_POP}, j AS (SELECT b.k::DOUBLE AS x, f.k::DOUBLE AS y FROM b JOIN f USING (document_id)) SELECT count(*) AS shared, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE {sql_pearson('x', 'y')} END AS spearman, round(count(*)::DOUBLE / (SELECT count(*) FROM b), 6) AS share FROM j")
def focused_robustness(spark, sf_dir):
    """Ranks within each population, compared over the documents of both."""
    c = R.scored_companies(spark, sf_dir)
    b = K.ordinal_rank(c, "total_score_100", [F.col("document_id")], "x").select("document_id", "x")
    f = K.ordinal_rank(c.where(F.col("segment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")), "total_score_100", [F.col("document_id")], "y").select("document_id", "y")
    j = b.join(f, "document_id", "left")
    shared = F.count("y")
    return j.agg(shared.alias("shared"), F.when(shared == 0, 0.0).when(shared == 1, 1.0).otherwise(pearson_of("x", "y")).alias("spearman"), F.round(shared / F.count("*"), 6).alias("share"))


@query("WITH r AS (" + SQL["rank_stability_summary"] + ") SELECT least_spearman, CASE WHEN least_spearman >= 0.9 THEN 'keep_base_weights' WHEN least_spearman >= 0.8 THEN 'report_alternatives' ELSE 'revise_weights' END AS recommendation, array_to_string(list_filter([CASE WHEN spearman_equal < 0.9 THEN 'equal' END, CASE WHEN spearman_facts < 0.9 THEN 'facts' END], lambda x: x IS NOT NULL), ';') AS sensitive_to FROM r")
def scheme_recommendation(spark, sf_dir):
    r = rank_stability_summary(spark, sf_dir)
    least = F.col("least_spearman")
    sensitive = F.array_compact(F.array(F.when(F.col("spearman_equal") < 0.9, "equal"), F.when(F.col("spearman_facts") < 0.9, "facts")))
    return r.select("least_spearman", F.when(least >= 0.9, "keep_base_weights").when(least >= 0.8, "report_alternatives").otherwise("revise_weights").alias("recommendation"), F.array_join(sensitive, ";").alias("sensitive_to"))


@query(f"WITH {_RUNS_SQL}, b AS (SELECT a.D2 AS x, r.D2 AS y FROM scores a JOIN redo r USING (document_id)) SELECT round(avg(greatest(0, 3 - x) / 4.0::DOUBLE), 6) AS first_error_rate, round(avg(greatest(0, 3 - y) / 4.0::DOUBLE), 6) AS second_error_rate, CASE WHEN avg(greatest(0, 3 - x)) <= avg(greatest(0, 3 - y)) THEN 'first' ELSE 'second' END AS recommended FROM b")
def method_comparison(spark, sf_dir):
    """How far below the middle the numeric dimension falls under two methods, and the better of them."""
    low = lambda c: F.avg(F.greatest(F.lit(0), 3 - F.col(c)) / 4.0)
    return _pair(spark, sf_dir).agg(F.round(low("D2"), 6).alias("first_error_rate"), F.round(low("b_D2"), 6).alias("second_error_rate"), F.when(low("D2") <= low("b_D2"), "first").otherwise("second").alias("recommended"))


@query(f"WITH {_RUNS_SQL} SELECT metric, value FROM (SELECT 'exact_agreement' AS metric, round(sum(same) / (5.0::DOUBLE * count(*)), 6) AS value FROM pair UNION ALL SELECT 'pearson', {sql_pearson('t1', 't2')} FROM pair UNION ALL SELECT 'mean_abs_diff', round(avg(abs(t1 - t2)), 6) FROM pair)")
def stability_metrics_long(spark, sf_dir):
    """Metrics of several kinds as rows, ready to append to a report's table."""
    m = _pair(spark, sf_dir).agg(F.round(F.sum("same") / (5.0 * F.count("*")), 6).alias("exact_agreement"), pearson_of("t1", "t2").alias("pearson"), F.round(F.avg(F.abs(F.col("t1") - F.col("t2"))), 6).alias("mean_abs_diff"))
    return m.unpivot([], ["exact_agreement", "pearson", "mean_abs_diff"], "metric", "value")
