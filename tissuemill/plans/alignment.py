"""Queries over labels, keys, gene sets, folds and files: what aligns tables with each other before anything is fitted."""

from __future__ import annotations

import csv
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify as C
from ..operators import expression as X
from ..operators import qc as Q
from ..sources import files
from .catalog import CLASSES, DUPES, KNN, PROB, K, Tables, composition, marker_topk, oracle, probabilities, query, rounded

#: Patients that the lookup does not know.
LOST = "EUROPE"
LOOKED = f"""pat AS (SELECT DISTINCT 's' || n_nationkey AS sample, patient FROM cells WHERE patient <> '{LOST}'),
looked AS (SELECT bulk_col, b.sample, coalesce(patient, 'UNK') AS patient FROM (SELECT DISTINCT bulk_col, regexp_extract(bulk_col, '^(s[0-9]+)', 1) AS sample FROM bulk) b LEFT JOIN pat USING (sample))"""


def looked_up(t: Tables) -> DataFrame:
    names = t.bulk().select("bulk_col").distinct().withColumn("sample", X.sample_of(F.col("bulk_col")))
    known = t.cells().where(F.col("patient") != LOST).select(F.concat(F.lit("s"), "n_nationkey").alias("sample"), "patient").distinct()
    return Q.lookup(names, "sample", known, "patient")


@query("patient_lookup", oracle("SELECT * FROM looked", LOOKED))
def patient_lookup(t: Tables) -> DataFrame:
    return looked_up(t)


@query("known_patients", oracle("SELECT * FROM looked WHERE patient <> 'UNK' AND bulk_col IN (SELECT bulk_col FROM truth WHERE NOT starts_with(bulk_col, 's2'))", LOOKED))
def known_patients(t: Tables) -> DataFrame:
    return Q.known_columns(looked_up(t), t.truth().where(~F.col("bulk_col").startswith("s2")))


SEEN = "seen AS (SELECT DISTINCT split, chemo, gene FROM expr JOIN cells USING (cell_id) WHERE value > 45)"


@query("marker_genes", oracle("SELECT gene FROM tops INTERSECT SELECT gene FROM seen WHERE split = 'train' INTERSECT SELECT gene FROM seen WHERE split = 'test' AND chemo = 'F'", DUPES + "," + SEEN))
def marker_genes(t: Tables) -> DataFrame:
    """Markers that both sides have, each side being what it shows in large counts."""
    seen = t.expr().where("value > 45").join(t.cells().select("cell_id", "split", "chemo"), "cell_id")
    return marker_topk(t).select("gene").intersect(X.align_genes(seen.where("split = 'train'"), seen.where("split = 'test' and chemo = 'F'")))


@query("fold_guards", oracle("""SELECT "outer", CAST(i AS INTEGER) AS "inner", CAST(sum(n_cells) AS BIGINT) AS n_cells, CAST(sum(n_columns) AS BIGINT) AS n_columns, sum(n_cells) >= 2800 AND sum(n_columns) >= 2 AS usable FROM (
  SELECT a.patient AS "outer", b.patient, (row_number() OVER (PARTITION BY a.patient ORDER BY b.patient) - 1) % least(5, count(*) OVER (PARTITION BY a.patient)) AS f, least(5, count(*) OVER (PARTITION BY a.patient)) AS k
  FROM (SELECT DISTINCT patient FROM cells) a JOIN (SELECT DISTINCT patient FROM cells) b ON a.patient <> b.patient), (SELECT unnest(range(5)) AS i),
  (SELECT patient AS p, count(*) AS n_cells, 2 * count(DISTINCT sample) AS n_columns FROM cells GROUP BY 1) WHERE i < k AND f <> i AND p = patient GROUP BY 1, 2"""))  # fmt: skip
def fold_guards(t: Tables) -> DataFrame:
    """Which folds have cells and bulk columns enough to be fitted."""
    sizes = t.cells().groupBy("patient").agg(F.count("*").alias("n_cells"), (2 * F.count_distinct("sample")).alias("n_columns"))
    train = C.lopo_folds(t.cells(), "patient").where("role = 'train'").join(F.broadcast(sizes), "patient")
    held = train.groupBy("outer", "inner").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_columns").alias("n_columns"))
    return held.withColumn("usable", (F.col("n_cells") >= 2800) & (F.col("n_columns") >= 2))


STRANGE = "CASE WHEN split = 'test' THEN CASE WHEN cell_id % 3 = 0 THEN 'UNK' WHEN cell_id % 3 = 1 THEN 'alien' ELSE cell_type END ELSE cell_type END"


@query("category_codes", oracle(f"""SELECT label, code, count(*) AS n FROM (SELECT {STRANGE} AS label FROM cells)
  LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT cell_type AS label FROM cells WHERE split = 'train' UNION SELECT 'UNK')) USING (label) GROUP BY 1, 2"""))  # fmt: skip
def category_codes(t: Tables) -> DataFrame:
    """Labels by their place among the union of the training labels and UNK; what is neither has no code."""
    labels = t.cells().select("split", F.expr(STRANGE).alias("label"))
    unknown = t.spark.createDataFrame([("UNK",)], "label string")
    coded = Q.category_codes(labels, "label", labels.where("split = 'train'"), unknown)
    return coded.groupBy("label", F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))


@query("label_union", oracle("SELECT row_number() OVER (ORDER BY label) - 1 AS place, label FROM (SELECT cell_type AS label FROM cells UNION SELECT chemo FROM cells UNION SELECT tumor FROM cells)"))
def label_union(t: Tables) -> DataFrame:
    c = t.cells()
    return Q.label_union("label", *(c.select(F.col(x).alias("label")) for x in ("cell_type", "chemo", "tumor"))).withColumn("place", F.col("place").cast("long"))


@query("fold_mean", oracle("SELECT cell_id, i AS class, round(avg(p), 6) AS p FROM px GROUP BY 1, 2", PROB))
def fold_mean(t: Tables) -> DataFrame:
    """Three folds' probabilities of a class, averaged."""
    p = probabilities(t)
    folds = p.select("cell_id", F.explode(F.array("m0", "m1", "m2")).alias("p"))
    mean = C.mean_probabilities(folds, ["cell_id"])
    return rounded(mean.select("cell_id", F.posexplode("p").alias("class", "p")).withColumn("class", F.col("class").cast("long")), "p")


@query("label_lists", oracle("SELECT sample, string_agg(DISTINCT tumor, ',' ORDER BY tumor) AS tumor FROM cells GROUP BY 1"))
def label_lists(t: Tables) -> DataFrame:
    return Q.distinct_joined(t.cells(), "sample", "tumor")


@query("sorted_by_id", oracle("SELECT cell_id, cell_type, row_number() OVER (ORDER BY cell_id) AS place FROM features"))
def sorted_by_id(t: Tables) -> DataFrame:
    """Rows in ascending order of their identifier; the place is told by the ranges the sort made, not by one task."""
    return numbered(t.features().select("cell_id", "cell_type"), "cell_id")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df sorted by key, with place from 1. The rows of each range are numbered by themselves."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
    ranged = df.withColumn("_part", part)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    placed = ranged.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.withColumn("place", place).select(*df.columns, "place").orderBy(key)


@query("union_source", oracle("SELECT source, count(*) AS n, sum(c_custkey) AS keys FROM (SELECT c_custkey, 'low' AS source FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'high' FROM customer WHERE c_acctbal > 5000) GROUP BY 1"))
def union_source(t: Tables) -> DataFrame:
    low = t.customer.where("c_acctbal < 0").drop("c_mktsegment")
    both = Q.union_with_source({"low": low, "high": t.customer.where("c_acctbal > 5000")})
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum("c_custkey").cast("double").alias("keys"))


@query("key_split", oracle("SELECT key, sample, cell_type || '|x' AS cell_type FROM (SELECT DISTINCT sample || '|' || cell_type || '|x' AS key, sample, cell_type FROM cells)"))
def key_split(t: Tables) -> DataFrame:
    """Keys joined by a bar and parted at the first one."""
    keys = t.cells().select(F.concat_ws("|", "sample", "cell_type", F.lit("x")).alias("key")).distinct()
    return keys.select("key", X.split_key(F.col("key")).alias("parts")).select("key", "parts.*")


@query("default_column", oracle("SELECT cell_type, 'UNK' AS stage, count(*) AS n FROM cells GROUP BY 1"))
def default_column(t: Tables) -> DataFrame:
    cells = Q.with_default(Q.with_default(t.cells(), "stage", F.lit("UNK")), "cell_type", F.lit("UNK"))
    return cells.groupBy("cell_type", "stage").agg(F.count("*").alias("n"))


TICKS = "ticks AS (SELECT gene, CAST(row_number() OVER (ORDER BY gene) AS INTEGER) AS place FROM (SELECT DISTINCT gene FROM expr))"


@query("heatmap_ticks", oracle("SELECT gene, place FROM ticks WHERE (place - 1) % ceil((SELECT count(*) FROM ticks) / 20.0) = 0", TICKS))
def heatmap_ticks(t: Tables) -> DataFrame:
    """Labels drawn on an axis that has room for 20."""
    genes = t.expr().select("gene").distinct()
    return Q.thin_ticks(genes.withColumn("place", F.row_number().over(Window.orderBy("gene"))), "place", 20)


MOMENTS = """nc AS (SELECT count(*) AS n FROM cells), lg1 AS (SELECT cell_id, gene, v FROM norm),
mo AS (SELECT gene, sum(v) / any_value(n) AS mean, sqrt((sum(v * v) - sum(v) * sum(v) / any_value(n)) / (any_value(n) - 1)) AS sd FROM lg1, nc GROUP BY 1)"""


def normal(t: Tables) -> DataFrame:
    return X.log1p(X.cp10k(t.expr()))


@query("scale_clip", oracle("SELECT cell_id, gene, round(least((v - mean) / sd, 3.0), 5) AS value, round(least(-mean / sd, 3.0), 5) AS zero FROM lg1 JOIN mo USING (gene)", MOMENTS))
def scale_clip(t: Tables) -> DataFrame:
    """Log values scaled to unit variance, zeros included, and cut at 3 (the study cuts at 10, which nothing here exceeds)."""
    return rounded(X.scale_clip(normal(t), t.cells().count(), 3.0), "value", "zero", digits=5)


@query("hvg_moments", oracle("""SELECT split, gene, round(sum(value) / any_value(n), 6) AS mean, round((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1), 4) AS var
  FROM expr JOIN cells USING (cell_id) JOIN (SELECT split, count(*) AS n FROM cells GROUP BY 1) USING (split) GROUP BY 1, 2"""))  # fmt: skip
def hvg_moments(t: Tables) -> DataFrame:
    """Mean and variance of each gene in each batch, zeros included: what gene selection starts from."""
    from ..operators import models as M

    return rounded(rounded(M.gene_moments(t.expr(), t.cells(), "split"), "mean"), "var", digits=4).select("split", "gene", "mean", "var")


TOPVAR = """tv AS (SELECT gene, sum(v * v) - sum(v) * sum(v) / any_value(n) AS s FROM lg1, nc GROUP BY 1), hv AS (SELECT gene FROM tv ORDER BY round(s, 6) DESC, gene LIMIT 20)"""


@query("hvg_union", oracle("SELECT gene FROM hv UNION SELECT gene FROM tops", DUPES + "," + MOMENTS + "," + TOPVAR))
def hvg_union(t: Tables) -> DataFrame:
    """The 20 genes of largest variance and all markers."""
    n = t.cells().count()
    top = X.scale_moments(normal(t), n).select("gene", F.round(F.col("sd") * F.col("sd") * (n - 1), 6).alias("s")).orderBy(F.col("s").desc(), "gene").limit(20)
    return X.chosen_or_all(files.staged(top), files.staged(marker_topk(t)), t.expr())  # both are asked whether they are empty


@query("hvg_or_all", oracle("SELECT DISTINCT gene FROM expr"))
def hvg_or_all(t: Tables) -> DataFrame:
    """Without a selected gene or marker all genes are taken."""
    none = t.genes().where("gene < 0")
    return X.chosen_or_all(none, none, t.expr())


@query("first_genes", oracle("(SELECT 'markers' AS chosen, gene FROM (SELECT DISTINCT gene FROM tops)) UNION ALL (SELECT 'first', gene FROM (SELECT DISTINCT gene FROM expr ORDER BY gene LIMIT 30))", DUPES))
def first_genes(t: Tables) -> DataFrame:
    """Markers as they are, and the first 30 genes where there are none."""
    tops = files.staged(marker_topk(t))  # asked twice whether it is empty
    found = X.markers_or_first(tops, t.expr(), 30).select(F.lit("markers").alias("chosen"), "gene")
    return found.unionByName(X.markers_or_first(tops.where("gene < 0"), t.expr(), 30).select(F.lit("first").alias("chosen"), "gene"))


L2 = """exl AS (SELECT cell_id, unnest(range(len(f))) AS d, CAST(unnest(f) AS DOUBLE) AS x FROM features),
dl AS (SELECT q.cell_id, t.cell_id AS neighbour, round(sqrt(sum((q.x - t.x) * (q.x - t.x))), 9) AS distance FROM exl q JOIN exl t ON q.d = t.d AND q.cell_id <> t.cell_id GROUP BY 1, 2),
graph AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbour) AS rank FROM dl)"""


def graph(t: Tables, k: int = 15) -> DataFrame:
    """cell_id, neighbour, distance, rank: the k nearest other rows by Euclidean distance."""
    f = t.features()
    near = C.knn(f, f, k + 1, metric="euclidean").where("query <> neighbour")
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("cell_id"), "neighbour", "distance", "rank")


@query("knn_graph", oracle("SELECT cell_id, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM graph WHERE rank <= 15", L2))
def knn_graph(t: Tables) -> DataFrame:
    return rounded(graph(t), "distance")


@query("knn_probed")
def knn_probed(t: Tables) -> DataFrame:
    """The 15 nearest other rows of every row whose id is divisible by 50, from the cells nearest to it only."""
    f = t.features()
    near = C.knn(f.where("cell_id % 50 = 0"), f, 16, metric="euclidean", probes=16, exact=False).where("query <> neighbour")
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    ranked = near.withColumn("rank", F.row_number().over(order)).where("rank <= 15")
    return rounded(ranked.select(F.col("query").alias("cell_id"), "neighbour", "distance", "rank"), "distance")


@query("umap_edges")
def umap_edges(t: Tables) -> DataFrame:
    """cell_id, neighbour, weight: the fuzzy union of the neighbour graph, which a layout starts from."""
    from ..operators import models as M

    return rounded(M.fuzzy_graph(graph(t)), "weight")


@query("scatter")
def scatter(t: Tables) -> DataFrame:
    """cell_id, x, y, colour: two principal components in place of a layout, coloured by the label."""
    from ..operators import models as M

    scores, _ = M.pca(t.features(), "f", 64, 2)
    return rounded(scores.select("cell_id", F.col("f")[0].alias("x"), F.col("f")[1].alias("y"), F.col("cell_type").alias("colour")), "x", "y")


@query("layout")
def layout(t: Tables) -> DataFrame:
    """cell_id, x, y, colour: the spectral layout of the fuzzy neighbour graph, coloured by the label."""
    from ..operators import layout as L
    from ..operators import models as M

    f = t.features().select("cell_id", F.col("cell_type").alias("colour"))
    return rounded(L.coordinates(M.fuzzy_graph(files.staged(graph(t)))).join(f, "cell_id"), "x", "y", digits=4)


@query("column_z", oracle("SELECT cell_id, d, round((x - avg(x) OVER (PARTITION BY d)) / (stddev_pop(x) OVER (PARTITION BY d) + 1e-9), 5) AS z FROM ex", KNN))
def column_z(t: Tables) -> DataFrame:
    """Every column of the embedding standardised."""
    long = t.features().select("cell_id", F.posexplode("f").alias("d", "v")).withColumn("d", F.col("d").cast("long"))
    return rounded(X.standardise(long, ["d"], "v").select("cell_id", "d", "z"), "z", digits=5)


@query("strata_z", oracle("SELECT cell_id, grp % 3 AS stratum, d, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-9), 5) AS z FROM ex WINDOW w AS (PARTITION BY grp % 3, d)", KNN))
def strata_z(t: Tables) -> DataFrame:
    """Every column of the embedding standardised inside each stratum."""
    long = t.features().select("cell_id", (F.col("grp") % 3).alias("stratum"), F.posexplode("f").alias("d", "v")).withColumn("d", F.col("d").cast("long"))
    return rounded(X.standardise(long, ["stratum", "d"], "v").select("cell_id", "stratum", "d", "z"), "z", digits=5)


@query("batch_moments", oracle("""SELECT sample, gene, round(avg(z), 5) AS g, round(var_samp(z), 5) AS d, count(*) AS n FROM (
  SELECT *, (m - avg(m) OVER (PARTITION BY gene)) / CASE WHEN sd <= 1e-12 THEN 1 ELSE sd END AS z FROM (SELECT *, sqrt(avg(r * r) OVER (PARTITION BY gene)) AS sd FROM (SELECT *, m - avg(m) OVER (PARTITION BY gene, sample) AS r FROM pb))) GROUP BY 1, 2"""))  # fmt: skip
def batch_moments(t: Tables) -> DataFrame:
    """Location and scale of each batch and gene, which batch correction shrinks."""
    from ..operators import models as M
    from .catalog import pb

    return rounded(M.batch_moments(M.batch_scaled(pb(t))), "g", "d", digits=5)


@query("kfold", oracle("SELECT fold, count(*) AS n, CAST(sum(cell_id) AS DOUBLE) AS ids FROM (SELECT cell_id, CAST((row_number() OVER (ORDER BY md5(CAST(cell_id AS VARCHAR)), cell_id) - 1) % 5 AS INTEGER) AS fold FROM cells) GROUP BY 1"))
def kfold(t: Tables) -> DataFrame:
    return C.folds(t.cells(), "kfold", "cell_type", "sample", "cell_id").groupBy("fold").agg(F.count("*").alias("n"), F.sum("cell_id").cast("double").alias("ids"))


@query("fold_counts", oracle("""SELECT 'group' AS mode, CAST(least(5, count(DISTINCT patient)) AS INTEGER) AS k FROM cells WHERE patient IN ('ASIA', 'AFRICA', 'EUROPE')
  UNION ALL SELECT 'stratified', CAST(greatest(2, least(5, min(n))) AS INTEGER) FROM (SELECT count(*) AS n FROM cells WHERE cell_id < 60 GROUP BY cell_type)
  UNION ALL SELECT 'kfold', CAST(greatest(2, least(5, count(*))) AS INTEGER) FROM cells WHERE cell_id < 4"""))  # fmt: skip
def fold_counts(t: Tables) -> DataFrame:
    """How many of the five folds asked for each mode allows on a small table."""
    c = t.cells()
    small = {"group": c.where(F.col("patient").isin("ASIA", "AFRICA", "EUROPE")), "stratified": c.where("cell_id < 60"), "kfold": c.where("cell_id < 4")}
    return t.spark.createDataFrame([(mode, C.fold_count(df, mode, "cell_type", "patient")) for mode, df in small.items()], "mode string, k int")


CVS = "cvs AS (SELECT k, cell_id % 5 AS fold, avg(CASE WHEN yhat = truth THEN 1.0 ELSE 0.0 END) AS accuracy FROM ft GROUP BY 1, 2)"


@query("cv_summary", oracle("SELECT 'm' || k AS model, round(avg(accuracy), 6) AS accuracy, count(*) AS folds FROM cvs GROUP BY 1", PROB + "," + CVS))
def cv_summary(t: Tables) -> DataFrame:
    """Mean score of each model over the folds."""
    p = probabilities(t).withColumn("fold", F.col("cell_id") % 5)
    long = p.select("fold", "truth", F.inline(F.array(*(F.struct(F.lit(f"m{k}").alias("model"), V.argmax(F.col(f"m{k}")).alias("yhat")) for k in range(3)))))
    scores = long.groupBy("model", "fold").agg(F.avg((F.col("yhat") == F.col("truth")).cast("double")).alias("accuracy"))
    return rounded(scores.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("folds")), "accuracy")


WEIGHTED = """wv AS (SELECT q.query, c.label, coalesce(sum(1 / (n.distance + 1e-12)), 0) AS votes FROM (SELECT DISTINCT query FROM nn) q CROSS JOIN (SELECT unnest(range(10)) AS label) c
  LEFT JOIN nn n ON n.query = q.query AND n.label = c.label AND n.rank <= 30 GROUP BY 1, 2)"""


@query("knn_weighted", oracle("SELECT query, CAST(label AS INTEGER) AS label, round(votes, 4) AS votes FROM wv", KNN + "," + WEIGHTED))
def knn_weighted(t: Tables) -> DataFrame:
    """Votes weighted by the reciprocal of the distance."""
    f = t.features()
    return rounded(C.knn_votes(C.knn(f.where("grp = 0"), f.where("grp <> 0")), list(range(10)), weighted=True).select("query", "label", "votes"), "votes", digits=4)


@query("features_file", oracle("SELECT cell_id, cell_type, CAST(list_sum(list_transform(f, lambda x: round(CAST(x AS DOUBLE), 4))) > 0 AS BOOLEAN) AS positive FROM features"))
def features_file(t: Tables) -> DataFrame:
    """The features written as CSV in the shared folder and read back with its checks."""
    f = t.features()
    path = files.shared_path(t.spark, "features.csv")
    files.write_features(f.select("cell_id", "cell_type", F.transform("f", lambda x: F.round(x, 4)).alias("f")), path, 64)
    back = files.read_features(t.spark, path)
    return back.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("cell_type").cast("int").alias("cell_type"), (sum((F.col(str(k)) for k in range(64)), F.lit(0.0)) > 0).alias("positive"))


@query("csv_preview", oracle("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5"))
def csv_preview(t: Tables) -> DataFrame:
    """The first rows and columns of a CSV file."""
    path = files.shared_path(t.spark, "customer.csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal").orderBy("c_custkey").write.csv(path, header=True)
    shown = files.preview(t.spark, f"{path}/part-00000*", 5, 2)  # the first of the files in order
    return shown.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("wide_csv", oracle("SELECT gene, bulk_col, coalesce(round(value, 4), 0) AS value FROM (SELECT DISTINCT gene FROM bulk) CROSS JOIN (SELECT DISTINCT bulk_col FROM bulk) LEFT JOIN bulk USING (gene, bulk_col)"))
def wide_csv(t: Tables) -> DataFrame:
    """A wide CSV with blank and foreign cells, read as long rows of numbers."""
    path = files.shared_path(t.spark, "bulk.csv")
    some = t.bulk()
    names = [r[0] for r in some.select("bulk_col").distinct().orderBy("bulk_col").collect()]
    genes = some.select("gene").distinct()
    wide = genes.join(some.groupBy("gene").pivot("bulk_col", names).agg(F.first(F.round("value", 4).cast("string"))), "gene", "left")
    wide.fillna("n/a", names).write.csv(path, header=True)
    return files.read_wide_csv(t.spark, path).select(F.col("gene").cast("long").alias("gene"), "bulk_col", "value")


@query("props_file", oracle("SELECT i AS place, cell_type, bulk_col, round(p, 6) AS p FROM comp JOIN cls USING (i)", f"""cls AS (SELECT unnest({list(CLASSES)}) AS cell_type, unnest(range({K})) AS i),
comp AS (SELECT b.bulk_col, i, coalesce(p, 0) AS p FROM (SELECT DISTINCT bulk_col FROM truth) b CROSS JOIN cls LEFT JOIN truth USING (bulk_col, cell_type))"""))  # fmt: skip
def props_file(t: Tables) -> DataFrame:
    """The proportion table as its file tells it: written on the driver, classes x bulk samples numbers, and read again."""
    path = Path(tempfile.mkdtemp()) / "props.csv"
    files.write_props(t.truth(), CLASSES, str(path))
    with path.open(newline="") as lines:
        head, *body = csv.reader(lines)
    rows = [(int(r[0]), r[1], c, round(float(v), 6)) for r in body for c, v in zip(head[2:], r[2:], strict=True)]
    return t.spark.createDataFrame(rows, "place long, cell_type string, bulk_col string, p double")


@query("result_archive", oracle(f"SELECT 'props.csv' AS name, CAST({K} + 1 AS INTEGER) AS lines UNION ALL SELECT 'runs.csv', CAST(count(*) + 1 AS INTEGER) FROM features"))
def result_archive(t: Tables) -> DataFrame:
    """Two result files packed into one archive; what it holds."""
    import zipfile

    folder = Path(tempfile.mkdtemp())
    files.write_props(t.truth(), CLASSES, str(folder / "props.csv"))
    with (folder / "runs.csv").open("w") as out:
        out.write("cell_id,pred\n")
        for a, b in t.features().select("cell_id", "cell_type").orderBy("cell_id").toLocalIterator():  # one partition at a time
            out.write(f"{a},{b}\n")
    files.pack([str(folder / "props.csv"), str(folder / "runs.csv")], str(folder / "result.zip"))
    with zipfile.ZipFile(folder / "result.zip") as held:
        rows = [(n, len(held.read(n).decode().splitlines())) for n in held.namelist()]
    return t.spark.createDataFrame(rows, "name string, lines int")


@query("truth_alignment", oracle("SELECT bulk_col, cell_type, round(coalesce(p, 0), 6) AS p FROM (SELECT DISTINCT bulk_col FROM bulk) CROSS JOIN (SELECT DISTINCT cell_type FROM cells) LEFT JOIN truth USING (bulk_col, cell_type)"))
def truth_alignment(t: Tables) -> DataFrame:
    """The truth of all bulk columns, in class order; a column without a truth would be an error."""
    asked = [r[0] for r in t.bulk().select("bulk_col").distinct().orderBy("bulk_col").collect()]
    found = aligned_truth(t, asked)
    return rounded(found.select("bulk_col", F.posexplode("p").alias("i", "p")).select("bulk_col", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("i") + 1).alias("cell_type"), "p"), "p")


def aligned_truth(t: Tables, columns: list[str]) -> DataFrame:
    """bulk_col, p of the columns; raises if one has no truth."""
    found = composition(t).where(F.col("bulk_col").isin(*columns))
    have = {r[0] for r in found.select("bulk_col").collect()}
    if missing := [c for c in columns if c not in have]:
        raise KeyError(f"no truth for {', '.join(missing)}")
    return found
