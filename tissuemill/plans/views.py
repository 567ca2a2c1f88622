"""The driver's star schema seen as an expression study.

cells: one per order that has lines. expr: summed quantities by cell and gene, non-zero pairs only. Genes are
suppliers; every twentieth one is mitochondrial. Sample and patient are nation and region, the label is the
market segment, bulk columns are samples in two replicates.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import staged

#: The label that plays the gated positive class.
POSITIVE = "BUILDING"
CLASSES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REPLICATES = 2
TEST_SHARE = 5


class Tables:
    """Lazily read tables of one directory, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        except AnalysisException as error:
            raise FileNotFoundError(f"no table {name} in {self.dir}") from error

    def with_cells_written(self) -> Tables:
        """These tables, the cells being written once instead of joined again by each view."""
        more, cells = Tables(self.spark, self.dir), staged(self.cells())
        more.cells = lambda: cells
        return more

    def cells(self) -> DataFrame:
        """cell_id, sample, patient, chemo, tumor, cell_type, split. Keys determine each other, so nothing is aggregated."""
        place = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        who = self.customer.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
        orders = self.orders.join(self.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        return orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("cell_id"),
            F.col("n_name").alias("sample"),
            F.col("r_name").alias("patient"),
            F.col("o_orderstatus").alias("chemo"),
            F.col("o_orderpriority").alias("tumor"),
            F.col("c_mktsegment").alias("cell_type"),
            F.when(F.col("o_orderkey") % TEST_SHARE == 0, "test").otherwise("train").alias("split"),
            "n_nationkey",
        )

    def expr(self) -> DataFrame:
        """cell_id, gene, value."""
        return self.lineitem.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))

    def genes(self) -> DataFrame:
        """gene, name."""
        return self.supplier.select(F.col("s_suppkey").alias("gene"), gene_name(F.col("s_suppkey")).alias("name"))

    def bulk(self) -> DataFrame:
        """gene, bulk_col, value: the bulk matrix in long form; names keep the capital letter some sources use."""
        cells = self.cells().select("cell_id", "n_nationkey")
        name = F.concat(F.lit("S"), F.col("n_nationkey"), F.lit("_"), F.col("l_linenumber") % REPLICATES)
        lines = self.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
        return (
            lines.join(cells, F.col("l_orderkey") == F.col("cell_id"))
            .groupBy(F.col("l_suppkey").alias("gene"), F.lower(name).alias("bulk_col"))
            .agg(F.sum("l_quantity").alias("value"))
        )

    def truth(self) -> DataFrame:
        """bulk_col, cell_type, p: shares of the labels in a sample, the same for its replicates."""
        counts = self.cells().groupBy("n_nationkey", "cell_type").agg(F.count("*").alias("n"))
        total = counts.groupBy("n_nationkey").agg(F.sum("n").alias("t"))
        shares = counts.join(total, "n_nationkey")
        copies = F.explode(F.array(*map(F.lit, range(REPLICATES)))).alias("r")
        return shares.select("*", copies).select(F.concat(F.lit("s"), "n_nationkey", F.lit("_"), "r").alias("bulk_col"), "cell_type", (F.col("n") / F.col("t")).alias("p"))

    def features(self) -> DataFrame:
        """cell_id, cell_type, grp, f: embeddings with their label."""
        return self.embeddings.select(
            F.col("vec_id").alias("cell_id"), F.col("label").alias("cell_type"), (F.col("vec_id") % 7).alias("grp"), F.col("embedding").cast("array<double>").alias("f")
        )


def gene_name(gene: Column) -> Column:
    return F.concat(F.when(gene % 20 == 0, F.lit("Mt-")).otherwise(F.lit("G")), gene)


#: The same views for the SQL oracles.
SQL = f"""
cells AS (SELECT o_orderkey AS cell_id, n_name AS sample, r_name AS patient, o_orderstatus AS chemo, o_orderpriority AS tumor,
    c_mktsegment AS cell_type, CASE WHEN o_orderkey % {TEST_SHARE} = 0 THEN 'test' ELSE 'train' END AS split, n_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
expr AS (SELECT l_orderkey AS cell_id, l_suppkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
genes AS (SELECT s_suppkey AS gene, CASE WHEN s_suppkey % 20 = 0 THEN 'Mt-' ELSE 'G' END || s_suppkey AS name FROM supplier),
bulk AS (SELECT l_suppkey AS gene, 's' || n_nationkey || '_' || (l_linenumber % {REPLICATES}) AS bulk_col, sum(l_quantity) AS value
  FROM lineitem JOIN cells ON l_orderkey = cell_id GROUP BY 1, 2),
truth AS (SELECT 's' || n_nationkey || '_' || r AS bulk_col, cell_type, n / sum(n) OVER (PARTITION BY n_nationkey, r) AS p
  FROM (SELECT n_nationkey, cell_type, count(*) AS n FROM cells GROUP BY 1, 2), (SELECT unnest(range({REPLICATES})) AS r)),
features AS (SELECT vec_id AS cell_id, label AS cell_type, vec_id % 7 AS grp, embedding AS f FROM embeddings),
lib AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1),
norm AS (SELECT cell_id, gene, ln(1 + value / CASE WHEN total = 0 THEN 1 ELSE total END * 10000.0) AS v FROM expr JOIN lib USING (cell_id)),
grp AS (SELECT sample, cell_type, count(*) AS n FROM cells GROUP BY 1, 2),
pb AS (SELECT g.sample, g.cell_type, x.gene, coalesce(s.s, 0) / g.n AS m FROM grp g CROSS JOIN (SELECT DISTINCT gene FROM expr) x
  LEFT JOIN (SELECT sample, cell_type, gene, sum(v) AS s FROM norm JOIN cells USING (cell_id) GROUP BY 1, 2, 3) s
  ON s.sample = g.sample AND s.cell_type = g.cell_type AND s.gene = x.gene)
"""


def oracle(body: str, more: str = "") -> str:
    return f"WITH {SQL}{',' + more if more else ''} {body}"
