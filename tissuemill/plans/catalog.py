"""Queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify as C
from ..operators import expression as X
from ..operators import qc as Q
from .views import CLASSES, POSITIVE, REPLICATES, Tables, oracle

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def normal(t: Tables) -> DataFrame:
    return X.log1p(X.cp10k(t.expr()))


def pb(t: Tables) -> DataFrame:
    return X.pseudobulk(normal(t), t.cells())


def weights(t: Tables) -> DataFrame:
    return t.cells().groupBy("sample", "cell_type").agg(F.count("*").alias("w"))


SCORES = """
mct AS (SELECT cell_type, gene, avg(m) AS m_ct FROM pb GROUP BY 1, 2),
mall AS (SELECT gene, avg(m) + 1e-9 AS m_all, count(DISTINCT cell_type) AS k FROM pb GROUP BY 1),
ratio AS (SELECT cell_type, gene, (m_ct + 1e-9) / ((m_all * k - m_ct) / greatest(1e-12, k - 1) + 1e-9) AS r FROM mct JOIN mall USING (gene)),
score AS (SELECT cell_type, gene, round(CASE WHEN r > 0 THEN log2(r) END, 6) AS score FROM ratio),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY score DESC NULLS LAST, gene) AS rank FROM score)"""
DUPES = SCORES + ", tops AS (SELECT * FROM ranked WHERE rank <= 10)"


@query("marker_topk", oracle("SELECT cell_type, gene, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10", SCORES))
def marker_topk(t: Tables) -> DataFrame:
    return X.top_k(X.contrast(pb(t)), 10)


@query("pseudobulk", oracle("SELECT sample, cell_type, gene, round(m, 6) AS m FROM pb"))
def pseudobulk(t: Tables) -> DataFrame:
    return rounded(pb(t), "m")


@query("signature", oracle("""SELECT cell_type, gene, round(coalesce(s, 0) / n, 6) AS m FROM (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1)
  CROSS JOIN (SELECT DISTINCT gene FROM expr) LEFT JOIN (SELECT cell_type, gene, sum(v) AS s FROM norm JOIN cells USING (cell_id) GROUP BY 1, 2) USING (cell_type, gene)"""))  # fmt: skip
def signature(t: Tables) -> DataFrame:
    return rounded(X.pseudobulk(normal(t), t.cells(), ("cell_type",)), "m")


QC = """qc AS (SELECT cell_id, count(*) FILTER (WHERE value <> 0) AS n_genes, sum(value) AS total_counts,
  100.0 * coalesce(sum(value) FILTER (WHERE upper(name) LIKE 'MT-%' OR starts_with(upper(name), 'MT_')), 0) / sum(value) AS pct_counts_mt
  FROM expr JOIN genes USING (gene) GROUP BY 1)"""


def qc(t: Tables) -> DataFrame:
    return Q.cell_qc(t.expr(), t.genes())


@query("cell_qc", oracle("SELECT cell_id, n_genes, total_counts, round(pct_counts_mt, 6) AS pct_counts_mt FROM qc", QC))
def cell_qc(t: Tables) -> DataFrame:
    return rounded(qc(t), "pct_counts_mt")


@query("mt_describe", oracle("UNPIVOT (SELECT " + ", ".join(
    ["CAST(count(*) AS DOUBLE) AS count", "round(avg(x), 6) AS mean", "round(stddev_samp(x), 6) AS std", "round(min(x), 6) AS min", "round(max(x), 6) AS max"]
    + [f"round(quantile_cont(x, {p}), 6) AS p{round(p * 100)}" for p in Q.PERCENTILES] + [f"round(avg(CASE WHEN x > {b} THEN 1.0 ELSE 0.0 END), 6) AS over_{b}" for b in (5, 10, 20)]
) + " FROM (SELECT pct_counts_mt AS x FROM qc)) ON COLUMNS(*) INTO NAME statistic VALUE value", QC))
def mt_describe(t: Tables) -> DataFrame:
    return rounded(Q.describe(qc(t), "pct_counts_mt"), "value")


@query("filter_cells_genes", oracle("""SELECT gene, count(*) AS n_cells, sum(value) AS total FROM fc WHERE gene IN (SELECT gene FROM fc WHERE value > 0 GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1""",
    "fc AS (SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) >= 4))"))
def filter_cells_genes(t: Tables) -> DataFrame:
    kept = Q.filter_genes(Q.filter_cells(t.expr(), 4), 3)
    return kept.groupBy("gene").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


COMBO = "coalesce(CAST(chemo AS VARCHAR), 'nan') || ' | ' || coalesce(CAST(tumor AS VARCHAR), 'nan')"


def with_combo(t: Tables) -> DataFrame:
    return t.cells().withColumn("combo", Q.combo(["chemo", "tumor"]))


@query("combo_qc", oracle(f"SELECT {COMBO} AS combo, count(*) AS n, round(median(total_counts), 6) AS median, round(avg(total_counts), 6) AS mean FROM cells JOIN qc USING (cell_id) GROUP BY 1", QC))
def combo_qc(t: Tables) -> DataFrame:
    return rounded(Q.group_stats(with_combo(t).join(qc(t), "cell_id"), ["combo"], "total_counts"), "median", "mean")


@query("combo_topk", oracle(f"SELECT combo, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT {COMBO} AS combo, count(*) AS n FROM cells GROUP BY 1) ORDER BY n DESC, combo LIMIT 5"))
def combo_topk(t: Tables) -> DataFrame:
    return Q.value_counts(with_combo(t), "combo").orderBy(F.col("n").desc(), "combo").limit(5)


@query("crosstab_props", oracle("""SELECT combo, cell_type, n, round(n / sum(n) OVER (PARTITION BY combo), 6) AS share FROM (SELECT combo, cell_type, count(*) AS n FROM k GROUP BY 1, 2)""",
    f"k AS (SELECT *, {COMBO} AS combo FROM cells)"))
def crosstab_props(t: Tables) -> DataFrame:
    wide = Q.crosstab(with_combo(t), "combo", "cell_type", list(CLASSES))
    counts = wide.unpivot(["combo"], list(CLASSES), "cell_type", "n").where("n > 0")
    return rounded(Q.row_shares(counts, "combo", "cell_type"), "share")


@query("class_totals", oracle("SELECT cell_type, count(*) AS n_cells, sum(value) AS total FROM cells JOIN expr USING (cell_id) GROUP BY 1"))
def class_totals(t: Tables) -> DataFrame:
    return t.expr().join(t.cells(), "cell_id").groupBy("cell_type").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


@query("library_size", oracle("SELECT bulk_col, CASE WHEN sum(value) = 0 THEN 1 ELSE sum(value) END AS lib FROM bulk GROUP BY 1 ORDER BY lib DESC, bulk_col LIMIT 20"))
def library_size(t: Tables) -> DataFrame:
    lib = t.bulk().groupBy("bulk_col").agg(F.sum("value").alias("lib")).withColumn("lib", F.when(F.col("lib") == 0, 1.0).otherwise(F.col("lib")))
    return lib.orderBy(F.col("lib").desc(), "bulk_col").limit(20)


@query("sample_mapping", oracle("SELECT sample, min_by(patient, cell_id) AS patient, min_by(chemo, cell_id) AS chemo, min_by(tumor, cell_id) AS tumor FROM cells GROUP BY 1"))
def sample_mapping(t: Tables) -> DataFrame:
    return Q.first_by(t.cells(), "sample", ["patient", "chemo", "tumor"], "cell_id")


KNOWN = "known AS (SELECT DISTINCT bulk_col FROM truth WHERE NOT regexp_matches(bulk_col, '^s[0-4]_'))"


@query("truth_semi_anti", oracle("SELECT DISTINCT bulk_col, bulk_col IN (SELECT bulk_col FROM known) AS has_truth FROM bulk", KNOWN))
def truth_semi_anti(t: Tables) -> DataFrame:
    known = t.truth().select("bulk_col").where(~F.col("bulk_col").rlike("^s[0-4]_")).distinct()
    columns = t.bulk().select("bulk_col").distinct()
    with_truth = columns.join(known, "bulk_col", "left_semi").withColumn("has_truth", F.lit(True))
    return with_truth.unionByName(columns.join(known, "bulk_col", "left_anti").withColumn("has_truth", F.lit(False)))


@query("sum_check", oracle("SELECT bulk_col, round(sum(p), 6) AS total FROM truth GROUP BY 1"))
def sum_check(t: Tables) -> DataFrame:
    return rounded(t.truth().groupBy("bulk_col").agg(F.sum("p").alias("total")), "total")


@query("hist_bins", oracle("""SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)) + 1, 50) AS INTEGER) AS bin, count(*) AS n
  FROM (SELECT total_counts AS x FROM qc), (SELECT min(total_counts) AS lo, max(total_counts) AS hi FROM qc) GROUP BY 1""", QC))  # fmt: skip
def hist_bins(t: Tables) -> DataFrame:
    return Q.histogram(qc(t), "total_counts")


@query("box_stats", oracle("""SELECT cell_type, min(n_genes) AS low, quantile_cont(n_genes, 0.25) AS q1, quantile_cont(n_genes, 0.5) AS median, quantile_cont(n_genes, 0.75) AS q3, max(n_genes) AS high
  FROM cells JOIN qc USING (cell_id) GROUP BY 1""", QC))  # fmt: skip
def box_stats(t: Tables) -> DataFrame:
    return Q.box_stats(t.cells().join(qc(t), "cell_id"), "cell_type", "n_genes")


@query("stacked_bars", oracle("""SELECT bulk_col, cell_type, round(p, 6) AS p,
  round(coalesce(sum(p) OVER (PARTITION BY bulk_col ORDER BY cell_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS bottom FROM truth"""))  # fmt: skip
def stacked_bars(t: Tables) -> DataFrame:
    return rounded(Q.stacked_bars(t.truth(), "bulk_col", "cell_type", "p"), "p", "bottom")


@query("cp10k", oracle("SELECT cell_id, gene, round(value / CASE WHEN total = 0 THEN 1 ELSE total END * 10000.0, 6) AS value FROM expr JOIN lib USING (cell_id)"))
def cp10k(t: Tables) -> DataFrame:
    return rounded(X.cp10k(t.expr()), "value")


BCP = "bcp AS (SELECT gene, bulk_col, value / sum(value) OVER (PARTITION BY bulk_col) * 10000.0 AS v FROM bulk)"
BUP = BCP + """, cols AS (SELECT DISTINCT bulk_col FROM bulk), bgrid AS (SELECT gene, coalesce(v, 0) AS v FROM (SELECT DISTINCT gene FROM bulk) CROSS JOIN cols LEFT JOIN bcp USING (gene, bulk_col)),
  up AS (SELECT gene, quantile_cont(v, 0.9) AS up FROM bgrid GROUP BY 1)"""


@query("winsor_quantile", oracle("SELECT gene, bulk_col, round(greatest(0, least(v, up)), 6) AS value, round(up, 6) AS up FROM bcp JOIN up USING (gene)", BUP))
def winsor_quantile(t: Tables) -> DataFrame:
    bulk = X.cp10k(t.bulk(), "bulk_col")
    up = X.sparse_quantile(bulk, "gene", bulk.select("bulk_col").distinct().count(), 0.9)
    return rounded(X.winsorise(bulk, up).join(up, "gene"), "value", "up").select("gene", "bulk_col", "value", "up")


@query("asinh_vst", oracle("SELECT gene, bulk_col, round(asinh(v / 2.0), 6) AS value FROM bcp", BCP))
def asinh_vst(t: Tables) -> DataFrame:
    return rounded(X.asinh(X.cp10k(t.bulk(), "bulk_col"), 2.0), "value")


@query("gene_intersect", oracle("SELECT gene FROM expr JOIN cells USING (cell_id) WHERE split = 'train' INTERSECT SELECT gene FROM expr JOIN cells USING (cell_id) WHERE split = 'test' INTERSECT SELECT gene FROM bulk"))
def gene_intersect(t: Tables) -> DataFrame:
    seen = t.expr().join(t.cells().select("cell_id", "split"), "cell_id").select("split", "gene").distinct()
    return seen.where("split = 'train'").select("gene").intersect(seen.where("split = 'test'").select("gene")).intersect(t.bulk().select("gene"))


MESSY = "CASE event_id % 11 WHEN 0 THEN 'UNK' WHEN 1 THEN ' unknown ' WHEN 2 THEN '' WHEN 3 THEN 'nan' WHEN 4 THEN NULL ELSE event_type END"


@query("split_masks", f"""SELECT label, is_test, count(*) AS n FROM (SELECT label, label IS NULL OR trim(label) = '' OR lower(trim(label)) = 'nan' OR upper(trim(label)) IN ('UNK', 'UNKNOWN') AS is_test
  FROM (SELECT {MESSY} AS label FROM events)) GROUP BY 1, 2""")  # fmt: skip
def split_masks(t: Tables) -> DataFrame:
    return Q.split_masks(t.events.select(F.expr(MESSY).alias("label")), "label").groupBy("label", "is_test").agg(F.count("*").alias("n"))


@query("numeric_features", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal FROM customer")
def numeric_features(t: Tables) -> DataFrame:
    return Q.numeric_features(t.customer.withColumn("same", F.lit(1)), ("c_custkey",))


RAW = "CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(user_id AS STRING) END"


@query("coerce_fill", f"SELECT event_id, coalesce(try_cast({RAW} AS DOUBLE), 0.0) AS value FROM events")
def coerce_fill(t: Tables) -> DataFrame:
    return t.events.select("event_id", Q.coerce(F.expr(RAW)).alias("value"))


@query("bulk_parse", oracle("""SELECT bulk_col, CASE WHEN regexp_extract(lower(bulk_col), '^(s[0-9]+)', 1) = '' THEN bulk_col ELSE regexp_extract(lower(bulk_col), '^(s[0-9]+)', 1) END AS sample
  FROM (SELECT DISTINCT bulk_col FROM bulk UNION ALL SELECT 'X' || bulk_col FROM (SELECT DISTINCT bulk_col FROM bulk) UNION ALL SELECT DISTINCT upper(bulk_col) FROM bulk)"""))  # fmt: skip
def bulk_parse(t: Tables) -> DataFrame:
    names = t.bulk().select("bulk_col").distinct()
    every = names.unionByName(names.select(F.concat(F.lit("X"), "bulk_col").alias("bulk_col"))).unionByName(names.select(F.upper("bulk_col").alias("bulk_col")))
    return every.select("bulk_col", X.sample_of(F.col("bulk_col")).alias("sample"))


@query("unique_markers", oracle("SELECT cell_type, gene, score, CAST(rank AS INTEGER) AS rank FROM tops WHERE gene NOT IN (SELECT gene FROM tops GROUP BY 1 HAVING count(*) >= 2)", DUPES))
def unique_markers(t: Tables) -> DataFrame:
    return X.unique_markers(marker_topk(t)).select("cell_type", "gene", "score", "rank")


@query("heatmap_z", oracle("""SELECT sample, pb.cell_type, pb.gene, u.cell_type AS of, CAST(dense_rank() OVER (ORDER BY u.cell_type, g.mean DESC, pb.gene) AS INTEGER) AS row_rank,
  CAST(dense_rank() OVER (ORDER BY pb.cell_type, sample) AS INTEGER) AS col_rank,
  round((m - avg(m) OVER (PARTITION BY pb.gene)) / CASE WHEN stddev_pop(m) OVER (PARTITION BY pb.gene) <= 0 THEN 1 ELSE stddev_pop(m) OVER (PARTITION BY pb.gene) END, 5) AS z
  FROM pb JOIN u USING (gene) JOIN (SELECT gene, round(avg(m), 9) AS mean FROM pb GROUP BY 1) g USING (gene)""",
    DUPES + ", u AS (SELECT cell_type, gene FROM tops WHERE gene NOT IN (SELECT gene FROM tops GROUP BY 1 HAVING count(*) >= 2))"))
def heatmap_z(t: Tables) -> DataFrame:
    return rounded(X.heatmap(pb(t), unique_markers(t)), "z", digits=5)


@query("weighted_heatmap", oracle("""SELECT cell_type, gene, round(mean, 6) AS mean, round((mean - avg(mean) OVER g) / CASE WHEN stddev_pop(mean) OVER g < 1e-9 THEN 1 ELSE stddev_pop(mean) OVER g END, 5) AS z
  FROM (SELECT cell_type, gene, sum(coalesce(n, 0) * m) / (sum(coalesce(n, 0)) + 1e-12) AS mean FROM pb LEFT JOIN grp USING (sample, cell_type) GROUP BY 1, 2) WINDOW g AS (PARTITION BY gene)"""))  # fmt: skip
def weighted_heatmap(t: Tables) -> DataFrame:
    return rounded(rounded(X.weighted_heatmap(pb(t), weights(t)), "mean"), "z", digits=5)


@query("cohens_d", oracle("""SELECT c AS cell_type, gene, round((mu1 - mu0) / sqrt((sum(CASE WHEN cell_type = c THEN n * (m - mu1) ** 2 ELSE 0 END) / any_value(w1) + sum(CASE WHEN cell_type <> c THEN n * (m - mu0) ** 2 ELSE 0 END) / any_value(w0)) / 2 + 1e-12), 5) AS d
  FROM (SELECT *, sum(CASE WHEN cell_type = c THEN n * m ELSE 0 END) OVER k / w1 AS mu1, sum(CASE WHEN cell_type <> c THEN n * m ELSE 0 END) OVER k / w0 AS mu0
    FROM (SELECT *, sum(CASE WHEN cell_type = c THEN n ELSE 0 END) OVER k + 1e-12 AS w1, sum(CASE WHEN cell_type <> c THEN n ELSE 0 END) OVER k + 1e-12 AS w0
      FROM pb JOIN grp USING (sample, cell_type) CROSS JOIN (SELECT DISTINCT cell_type AS c FROM cells) WINDOW k AS (PARTITION BY c, gene)) WINDOW k AS (PARTITION BY c, gene)) GROUP BY c, gene, mu1, mu0"""))  # fmt: skip
def cohens_d(t: Tables) -> DataFrame:
    return rounded(X.cohens_d(pb(t), weights(t)), "d", digits=5)


ROBUST = """cen AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY sample, gene) > 1 THEN m - avg(m) OVER (PARTITION BY sample, gene) ELSE m END AS c FROM pb),
rob AS (SELECT k AS cell_type, gene, avg(c) FILTER (WHERE cell_type = k) - coalesce(avg(c) FILTER (WHERE cell_type <> k), 0) AS score FROM cen CROSS JOIN (SELECT DISTINCT cell_type AS k FROM cells) GROUP BY 1, 2)"""


@query("batch_robust", oracle("SELECT cell_type, gene, round(score, 6) AS score FROM rob", ROBUST))
def batch_robust(t: Tables) -> DataFrame:
    return rounded(X.batch_robust_contrast(pb(t)), "score")


@query("ranknorm", oracle("""SELECT cell_type, gene, s AS score, round(CASE WHEN s > 0 THEN row_number() OVER (PARTITION BY cell_type, s > 0 ORDER BY s, gene) / (count(*) OVER (PARTITION BY cell_type, s > 0) + 1.0) ELSE 0 END, 6) AS rank_norm
  FROM (SELECT cell_type, gene, round(score, 6) AS s FROM rob)""", ROBUST))  # fmt: skip
def ranknorm(t: Tables) -> DataFrame:
    return rounded(X.rank_norm(batch_robust(t), "cell_type", "score", "gene"), "rank_norm")


def composition(t: Tables) -> DataFrame:
    """bulk_col, p: proportions in the fixed class order, absent classes 0."""
    wide = t.truth().groupBy("bulk_col").pivot("cell_type", list(CLASSES)).agg(F.first("p"))
    return wide.select("bulk_col", F.array(*(F.coalesce(c, F.lit(0.0)) for c in CLASSES)).alias("p"))


K = len(CLASSES)
COMP = f"""cls AS (SELECT unnest({list(CLASSES)}) AS cell_type, unnest(range({K})) AS i),
comp AS (SELECT b.bulk_col, i, coalesce(p, 0) AS p FROM (SELECT DISTINCT bulk_col FROM truth) b CROSS JOIN cls LEFT JOIN truth USING (bulk_col, cell_type)),
lg AS (SELECT bulk_col, i, ln(greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY bulk_col)) AS l FROM comp),
hel AS (SELECT i, j, CASE WHEN i < j THEN 1.0 / j WHEN i = j THEN -1.0 ELSE 0.0 END / sqrt(1.0 / j + 1.0) AS h FROM (SELECT unnest(range({K})) AS i), (SELECT unnest(range(1, {K})) AS j))"""


@query("ilr", oracle("SELECT bulk_col, j AS coordinate, round(sum(l * h), 6) AS z FROM lg JOIN hel USING (i) GROUP BY 1, 2", COMP))
def ilr(t: Tables) -> DataFrame:
    z = composition(t).select("bulk_col", F.posexplode(V.ilr(F.col("p"), K)).alias("at", "z"))
    return rounded(z.select("bulk_col", (F.col("at") + 1).cast("long").alias("coordinate"), "z"), "z")


@query("ilr_roundtrip", oracle("SELECT bulk_col, i AS class, round(greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY bulk_col), 6) AS p FROM comp", COMP))
def ilr_roundtrip(t: Tables) -> DataFrame:
    back = composition(t).select("bulk_col", F.posexplode(V.ilr_inverse(V.ilr(F.col("p"), K), K)).alias("class", "p"))
    return rounded(back.withColumn("class", F.col("class").cast("long")), "p")


NOISY = "p * 1.7 - 0.1 * i"


@query("simplex_proj", oracle("SELECT bulk_col, i AS class, round(greatest(v - theta, 0), 6) AS p FROM nv JOIN th USING (bulk_col)", COMP + f""",
nv AS (SELECT bulk_col, i, {NOISY} AS v FROM comp),
th AS (SELECT bulk_col, max_by((s - 1) / k, k) AS theta FROM (SELECT *, row_number() OVER o AS k, sum(v) OVER (o ROWS UNBOUNDED PRECEDING) AS s FROM nv WINDOW o AS (PARTITION BY bulk_col ORDER BY v DESC, i)) WHERE v * k > s - 1 GROUP BY 1)"""))  # fmt: skip
def simplex_proj(t: Tables) -> DataFrame:
    noisy = F.transform("p", lambda p, i: p * 1.7 - 0.1 * i)
    out = composition(t).select("bulk_col", F.posexplode(V.simplex(noisy)).alias("class", "p"))
    return rounded(out.withColumn("class", F.col("class").cast("long")), "p")


@query("bag_mean", oracle(f"""SELECT bulk_col, i AS class, round(coalesce(v, 1.0 / {K}), 6) AS p FROM (SELECT DISTINCT bulk_col FROM truth) CROSS JOIN cls
  LEFT JOIN (SELECT bulk_col, i, avg(p * (1 - 0.1 * f) + 0.02 * f) AS v FROM comp CROSS JOIN (SELECT unnest(range(3)) AS f) WHERE NOT starts_with(bulk_col, 's1') GROUP BY 1, 2) USING (bulk_col, i)""", COMP))  # fmt: skip
def bag_mean(t: Tables) -> DataFrame:
    rows = composition(t).select("bulk_col", F.posexplode("p").alias("class", "p")).withColumn("class", F.col("class").cast("long"))
    folds = rows.where(~F.col("bulk_col").startswith("s1")).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(2))))
    bags = folds.groupBy("bulk_col", "class").agg(F.avg(F.col("p") * (1 - 0.1 * F.col("f")) + 0.02 * F.col("f")).alias("v"))
    return rounded(rows.join(bags, ["bulk_col", "class"], "left").select("bulk_col", "class", F.coalesce("v", F.lit(1.0 / K)).alias("p")), "p")


@query("rmse", oracle("""SELECT cell_type, round(sqrt(avg((q - p) ** 2)), 6) AS rmse FROM (SELECT cell_type, p, avg(p) OVER (PARTITION BY cell_type) AS q FROM (SELECT c.cell_type, comp.p FROM comp JOIN cls c USING (i))) GROUP BY 1
  UNION ALL SELECT 'AVERAGE', round(avg(r), 6) FROM (SELECT sqrt(avg((q - p) ** 2)) AS r FROM (SELECT i, p, avg(p) OVER (PARTITION BY i) AS q FROM comp) GROUP BY i)""", COMP))  # fmt: skip
def rmse(t: Tables) -> DataFrame:
    rows = composition(t).select(F.posexplode("p").alias("i", "p"))
    rows = rows.select(F.element_at(F.array(*map(F.lit, CLASSES)), F.col("i") + 1).alias("cell_type"), "p").withColumn("q", F.avg("p").over(Window.partitionBy("cell_type")))
    per = rows.groupBy("cell_type").agg(F.sqrt(F.avg((F.col("q") - F.col("p")) ** 2)).alias("rmse"))
    return rounded(per.unionByName(per.agg(F.lit("AVERAGE").alias("cell_type"), F.avg("rmse").alias("rmse"))), "rmse")


@query("sample_weights", oracle("SELECT cell_type, round(least(sum(n) OVER () / (count(*) OVER () * n), 5.0), 6) AS weight FROM (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1)"))
def sample_weights(t: Tables) -> DataFrame:
    return rounded(C.class_weights(t.cells(), "cell_type"), "weight")


KNN = """ex AS (SELECT cell_id, cell_type, grp, unnest(range(len(f))) AS d, CAST(unnest(f) AS DOUBLE) AS x FROM features),
un AS (SELECT cell_id, cell_type, grp, d, x / sqrt(sum(x * x) OVER (PARTITION BY cell_id)) AS x FROM ex),
ds AS (SELECT q.cell_id AS query, t.cell_id AS neighbour, any_value(t.cell_type) AS label, round(1 - sum(q.x * t.x), 9) AS distance
  FROM un q JOIN un t ON q.d = t.d WHERE q.grp = 0 AND t.grp <> 0 GROUP BY 1, 2),
nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM ds),
votes AS (SELECT q.query, c.label, count(n.neighbour) AS votes FROM (SELECT DISTINCT query FROM nn) q CROSS JOIN (SELECT unnest(range(10)) AS label) c
  LEFT JOIN nn n ON n.query = q.query AND n.label = c.label AND n.rank <= 30 GROUP BY 1, 2),
pr AS (SELECT query, label, votes, exp(votes - max(votes) OVER w) / (sum(exp(votes - mv)) OVER w + 1e-12) AS p FROM (SELECT *, max(votes) OVER (PARTITION BY query) AS mv FROM votes) WINDOW w AS (PARTITION BY query))"""


def votes(t: Tables) -> DataFrame:
    f = t.features()
    return C.knn_votes(C.knn(f.where("grp = 0"), f.where("grp <> 0")), list(range(10)))


@query("knn_vote", oracle("SELECT query, CAST(label AS INTEGER) AS label, votes, round(p, 6) AS p FROM pr", KNN))
def knn_vote(t: Tables) -> DataFrame:
    return rounded(votes(t), "p")


def probabilities(t: Tables) -> DataFrame:
    """cell_id, truth, p_t and three models' probabilities of the ten classes.

    Every value of the embedding counts: the one at place d for class d % 10 of model d div 10 % 3.
    """
    f = t.features()

    def scores(k: int) -> Column:
        return F.array(*(sum((F.get("f", F.lit(d)) for d in range(c, 64, 10) if d // 10 % 3 == k), F.lit(0.0)) * 4 for c in range(10)))

    return f.select("cell_id", F.col("cell_type").alias("truth"), *(V.softmax(scores(k)).alias(f"m{k}") for k in range(3))).withColumn("p_t", F.get("m0", F.lit(0)))


PROB = """lx AS (SELECT cell_id, cell_type AS truth, d // 10 % 3 AS k, d % 10 AS i, sum(x) * 4 AS x FROM (SELECT cell_id, cell_type, unnest(range(64)) AS d, CAST(unnest(f) AS DOUBLE) AS x FROM features) GROUP BY ALL),
px AS (SELECT cell_id, truth, k, i, exp(x - mx) / (sum(exp(x - mx)) OVER (PARTITION BY cell_id, k) + 1e-12) AS p FROM (SELECT *, max(x) OVER (PARTITION BY cell_id, k) AS mx FROM lx)),
ft AS (SELECT cell_id, any_value(truth) AS truth, k, max(p) AS top1, max(p) - max(p) FILTER (WHERE r = 2) AS d1, max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2) AS margin,
  -sum(least(greatest(p, 1e-12), 1) * ln(least(greatest(p, 1e-12), 1))) AS entropy, min(i) FILTER (WHERE r = 1) AS yhat, any_value(p) FILTER (WHERE i = 0) AS p0
  FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, k ORDER BY p DESC, i) AS r FROM px) GROUP BY cell_id, k),
w AS (SELECT cell_id, any_value(truth) AS truth, any_value(p0) FILTER (WHERE k = 0) AS p_t, """ + ", ".join(
    f"any_value({c}) FILTER (WHERE k = {k}) AS m{k}_{c}" for k in range(3) for c in ("top1", "margin", "entropy", "yhat")) + " FROM ft GROUP BY cell_id)"


@query("softmax_entropy", oracle("SELECT cell_id, round(m0_top1, 6) AS top1, round(m0_margin, 6) AS margin, round(m0_entropy, 6) AS entropy, CAST(m0_yhat AS INTEGER) AS yhat FROM w", PROB))
def softmax_entropy(t: Tables) -> DataFrame:
    p = F.col("m0")
    return rounded(probabilities(t).select("cell_id", V.top1(p).alias("top1"), V.margin(p).alias("margin"), V.entropy(p).alias("entropy"), V.argmax(p).alias("yhat")), "top1", "margin", "entropy")


@query("t_gate", oracle("SELECT cell_id, CAST(CASE WHEN p_t >= 0.55 THEN 0 ELSE m1_yhat END AS INTEGER) AS yhat FROM w", PROB))
def t_gate(t: Tables) -> DataFrame:
    return probabilities(t).select("cell_id", V.gate(V.argmax(F.col("m1")), F.col("p_t"), 0).alias("yhat"))


@query("meta_features", oracle("SELECT cell_id, round(p_t, 6) AS p_t, " + ", ".join(f"round(m{k}_{c}, 6) AS m{k}_{c}" for k in range(3) for c in ("top1", "margin", "entropy"))
    + ", " + ", ".join(f"CAST(m{a}_yhat = m{b}_yhat AS INTEGER) AS agree_m{a}_m{b}" for a, b in ((0, 1), (0, 2), (1, 2))) + " FROM w", PROB))
def meta_features(t: Tables) -> DataFrame:
    out = C.meta_features(probabilities(t), ["m0", "m1", "m2"]).drop("truth", "m0", "m1", "m2")
    return rounded(out, *(c for c in out.columns if c != "cell_id" and not c.startswith("agree")))


@query("meta_target", oracle("""SELECT cell_id, CAST(CASE WHEN best IS NULL THEN CASE WHEN m0_margin >= m1_margin AND m0_margin >= m2_margin THEN 0 WHEN m1_margin >= m2_margin THEN 1 ELSE 2 END
  WHEN m0_yhat = truth AND m0_margin = best THEN 0 WHEN m1_yhat = truth AND m1_margin = best THEN 1 ELSE 2 END AS INTEGER) AS choice
  FROM (SELECT *, greatest(CASE WHEN m0_yhat = truth THEN m0_margin END, CASE WHEN m1_yhat = truth THEN m1_margin END, CASE WHEN m2_yhat = truth THEN m2_margin END) AS best FROM w)""", PROB))  # fmt: skip
def meta_target(t: Tables) -> DataFrame:
    models = [F.col(f"m{k}") for k in range(3)]
    return probabilities(t).select("cell_id", C.meta_target(F.col("truth"), [V.argmax(m) for m in models], [V.margin(m) for m in models]).alias("choice"))


@query("metrics_ari_v", oracle("""SELECT round(hits / n, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1, round(ari, 6) AS ari, round(v, 6) AS v_measure, round((ari + v) / 2, 6) AS score FROM (
  SELECT *, (pj - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS ari, 2 * hom * com / (hom + com) AS v FROM (
  SELECT *, 1 - htp / ht AS hom, 1 - hpt / hp AS com FROM (
  SELECT CAST(sum(n) AS DOUBLE) AS n, sum(n) FILTER (WHERE t = p) AS hits, sum(n * (n - 1) / 2) AS pj,
    -sum(n / tot * ln(n / b)) AS htp, -sum(n / tot * ln(n / a)) AS hpt FROM j),
  (SELECT sum(a * (a - 1) / 2) AS pa, -sum(a / tot * ln(a / tot)) AS ht, avg(hit / a) AS bal FROM (SELECT t, any_value(a) AS a, any_value(tot) AS tot, coalesce(sum(n) FILTER (WHERE t = p), 0) AS hit FROM j GROUP BY t)),
  (SELECT sum(b * (b - 1) / 2) AS pb, -sum(b / tot * ln(b / tot)) AS hp FROM (SELECT p, any_value(b) AS b, any_value(tot) AS tot FROM j GROUP BY p)),
  (SELECT avg(2.0 * hit / (a + b)) AS f1 FROM (SELECT c, coalesce(any_value(a) FILTER (WHERE t = c), 0) AS a, coalesce(any_value(b) FILTER (WHERE p = c), 0) AS b, coalesce(sum(n) FILTER (WHERE t = c AND p = c), 0) AS hit
    FROM j, (SELECT t AS c FROM j UNION SELECT p FROM j) GROUP BY c))))""", PROB + """,
j AS (SELECT *, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY p) AS DOUBLE) AS b, CAST(sum(n) OVER () AS DOUBLE) AS tot FROM (SELECT truth AS t, m0_yhat AS p, count(*) AS n FROM w GROUP BY 1, 2))"""))  # fmt: skip
def metrics_ari_v(t: Tables) -> DataFrame:
    cm = C.confusion(probabilities(t).withColumn("yhat", V.argmax(F.col("m0"))), "truth", "yhat")
    out = C.metrics(cm)
    return rounded(out, *out.columns)


VOTE = """SELECT cell_id, pred_1, pred_2, pred_3, CASE WHEN (CASE WHEN pred_1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN pred_2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN pred_3 IS NULL THEN 0 ELSE 1 END) = 0 THEN NULL
  WHEN pred_1 = pred_2 OR pred_1 = pred_3 THEN pred_1 WHEN pred_2 = pred_3 THEN pred_2 ELSE pred_1 END AS final_pred
  FROM (SELECT cell_id, m0_yhat AS pred_1 FROM w WHERE cell_id % 3 <> 0) FULL JOIN (SELECT cell_id, m1_yhat AS pred_2 FROM w WHERE cell_id % 4 <> 1) USING (cell_id)
  FULL JOIN (SELECT cell_id, m2_yhat AS pred_3 FROM w WHERE cell_id % 5 <> 2) USING (cell_id)"""


@query("vote3", oracle(f"SELECT cell_id, CAST(pred_1 AS INTEGER) AS pred_1, CAST(pred_2 AS INTEGER) AS pred_2, CAST(pred_3 AS INTEGER) AS pred_3, CAST(final_pred AS INTEGER) AS final_pred FROM ({VOTE})", PROB))
def vote3(t: Tables) -> DataFrame:
    p = probabilities(t)
    runs = [p.where(keep).select("cell_id", V.argmax(F.col(f"m{k}")).alias("pred")) for k, keep in enumerate(("cell_id % 3 <> 0", "cell_id % 4 <> 1", "cell_id % 5 <> 2"))]
    return C.vote_three(*runs)


@query("group_folds", oracle("""SELECT sample, CAST(fold AS INTEGER) AS fold FROM pack""", """gs AS (SELECT sample, n, row_number() OVER (ORDER BY n DESC, sample) AS o FROM (SELECT sample, count(*) AS n FROM cells GROUP BY 1)),
pack AS (WITH RECURSIVE r(o, sample, fold, load) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(-1 AS BIGINT), [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT g.o, g.sample, list_position(r.load, list_min(r.load)) - 1, list_transform(r.load, lambda x, i: CASE WHEN i = list_position(r.load, list_min(r.load)) THEN x + g.n ELSE x END)
  FROM r JOIN gs g ON g.o = r.o + 1) SELECT sample, fold FROM r WHERE o > 0)"""))  # fmt: skip
def group_folds(t: Tables) -> DataFrame:
    return C.group_folds(t.cells().groupBy("sample").agg(F.count("*").alias("n")), "sample", "n", 5)


@query("strat_folds", oracle("SELECT cell_type, fold, count(*) AS n, sum(cell_id) AS ids FROM (SELECT cell_type, cell_id, CAST((row_number() OVER (PARTITION BY cell_type ORDER BY md5(CAST(cell_id AS VARCHAR)), cell_id) - 1) % 5 AS INTEGER) AS fold FROM cells) GROUP BY 1, 2"))
def strat_folds(t: Tables) -> DataFrame:
    return C.stratified_folds(t.cells(), "cell_type", "cell_id", 5).groupBy("cell_type", "fold").agg(F.count("*").alias("n"), F.sum("cell_id").cast("double").alias("ids"))


@query("lopo_folds", oracle("""SELECT "outer", CAST(i AS INTEGER) AS "inner", patient, CASE WHEN f = i THEN 'valid' ELSE 'train' END AS role FROM (
  SELECT a.patient AS "outer", b.patient, (row_number() OVER (PARTITION BY a.patient ORDER BY b.patient) - 1) % least(5, count(*) OVER (PARTITION BY a.patient)) AS f, least(5, count(*) OVER (PARTITION BY a.patient)) AS k
  FROM (SELECT DISTINCT patient FROM cells) a JOIN (SELECT DISTINCT patient FROM cells) b ON a.patient <> b.patient), (SELECT unnest(range(5)) AS i) WHERE i < k"""))  # fmt: skip
def lopo_folds(t: Tables) -> DataFrame:
    return C.lopo_folds(t.cells(), "patient")


CV = """cv AS (SELECT cell_id % 5 AS fold, k, avg(CASE WHEN yhat = truth THEN 1.0 ELSE 0.0 END) AS accuracy FROM ft GROUP BY 1, 2)"""


@query("cv_pivot", oracle("SELECT fold, " + ", ".join(f"round(max(accuracy) FILTER (WHERE k = {k}), 6) AS m{k}" for k in range(3)) + " FROM cv GROUP BY 1", PROB + "," + CV))
def cv_pivot(t: Tables) -> DataFrame:
    p = probabilities(t).withColumn("fold", F.col("cell_id") % 5)
    long = p.select("fold", "truth", F.inline(F.array(*(F.struct(F.lit(f"m{k}").alias("model"), V.argmax(F.col(f"m{k}")).alias("yhat")) for k in range(3)))))
    scores = long.groupBy("fold").pivot("model", ["m0", "m1", "m2"]).agg(F.avg((F.col("yhat") == F.col("truth")).cast("double")))
    return rounded(scores, "m0", "m1", "m2")


@query("pred_distribution", oracle("SELECT CAST(m0_yhat AS INTEGER) AS yhat, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS VARCHAR) || '%' AS share FROM w GROUP BY 1", PROB))
def pred_distribution(t: Tables) -> DataFrame:
    counts = Q.value_counts(probabilities(t).select(V.argmax(F.col("m0")).alias("yhat")), "yhat")
    return counts.select("yhat", "n", F.concat(F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).cast("string"), F.lit("%")).alias("share"))


@query("props_wide", oracle(f"SELECT CAST(i AS INTEGER) AS row_number, cell_type AS index, " + ", ".join(f"round(max(coalesce(p, 0)) FILTER (WHERE bulk_col = 's{s}_{r}'), 6) AS s{s}_{r}" for s in range(25) for r in range(REPLICATES)) + " FROM comp JOIN cls USING (i) GROUP BY 1, 2", COMP))
def props_wide(t: Tables) -> DataFrame:
    columns = [r[0] for r in t.truth().select("bulk_col").distinct().orderBy("bulk_col").collect()]
    rows = composition(t).select("bulk_col", F.posexplode("p").alias("row_number", "p"))
    wide = rows.groupBy("row_number").pivot("bulk_col", columns).agg(F.round(F.max("p"), 6))
    return wide.select("row_number", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("row_number") + 1).alias("index"), *columns)


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["POSITIVE", "Tables", "oracle_sql", "queries"]
