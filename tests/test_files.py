import csv
import os
import zipfile

import pytest

from tissuemill.sources import files


def test_wide_csv_is_long_and_numeric(spark, tmp_path):
    path = tmp_path / "bulk.csv"
    path.write_text('gene,s1.a,s2_1\ng1,1.5,x\ng2,,-2e1\n')
    got = sorted(map(tuple, files.read_wide_csv(spark, str(path)).collect()))
    assert got == [("g1", "s1.a", 1.5), ("g1", "s2_1", 0.0), ("g2", "s1.a", 0.0), ("g2", "s2_1", -20.0)]
    path.write_text("gene\ng1\n")
    with pytest.raises(ValueError):
        files.read_wide_csv(spark, str(path))


def test_props_keep_their_order_and_replace_a_read_only_file(spark, tmp_path):
    path = tmp_path / "out" / "props.csv"
    props = spark.createDataFrame([("s1", "b", 0.25), ("s1", "z", 0.75), ("s2", "a", 1.0)], "bulk_col string, cell_type string, p double")
    for _ in range(2):
        files.write_props(props, ["b", "a", "c"], str(path))
        os.chmod(path, 0o444)
    assert list(csv.reader(path.open())) == [
        ["", "index", "s1", "s2"], ["0", "b", "0.25", "0.0"], ["1", "a", "0.0", "1.0"], ["2", "c", "0.0", "0.0"], ["3", "z", "0.75", "0.0"]
    ]


def test_pack_needs_every_file(tmp_path):
    one, two, out = tmp_path / "one.csv", tmp_path / "two.csv", tmp_path / "both.zip"
    one.write_text("a\n")
    two.write_text("b\n" * 1000)
    for _ in range(2):
        assert files.pack([str(one), str(two)], str(out)) == ["one.csv", "two.csv"]
    with pytest.raises(FileNotFoundError):
        files.pack([str(one), str(tmp_path / "none.csv")], str(out))
    with zipfile.ZipFile(out) as packed:
        assert packed.read("two.csv") == two.read_bytes() and packed.getinfo("two.csv").compress_type == zipfile.ZIP_DEFLATED


def test_feature_files(spark, tmp_path):

    path = f"file://{tmp_path}/deep/features"
    f = spark.createDataFrame([(1, "a", [0.5, 2.0]), (2, "b", [float("nan"), -1.0])], "cell_id long, cell_type string, f array<double>")
    files.write_features(f, path, 2)
    files.write_features(f, path, 2)  # replaced
    assert sorted(map(tuple, files.read_features(spark, path).collect())) == [("1", "a", 0.5, 2.0), ("2", "b", 0.0, -1.0)]
    assert files.preview(spark, path, 1, 2).columns == ["cell_id", "cell_type"] and files.preview(spark, path, 1, 2).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_features(spark, f"file://{tmp_path}/nothing")
    files.write_features(f.limit(0), path, 2)
    with pytest.raises(ValueError):
        files.read_features(spark, path)


def test_proportions_either_way_round(spark):
    wide = spark.createDataFrame([("T", 0.2, 0.3), ("B", 0.8, 0.7)], "index string, s1_0 double, s1_1 double")
    turned = spark.createDataFrame([("s1_0", 0.2, 0.8), ("s1_1", 0.3, 0.7)], "name string, T double, B double")
    for table in (wide, turned):
        rows = sorted(map(tuple, files.oriented(table, ["T", "B"]).collect()))
        assert rows == [("s1_0", "B", 0.8), ("s1_0", "T", 0.2), ("s1_1", "B", 0.7), ("s1_1", "T", 0.3)]


def test_a_matrix_as_three_tables(spark, tmp_path):
    import numpy as np

    from tissuemill.sources import anndata

    class Group(dict):
        pass

    dense = np.array([[0, 2.0, 0], [1.0, 0, 3.0], [0, 0, 0]])
    sparse = Group(data=np.array([2.0, 1.0, 3.0]), indices=np.array([1, 0, 2]), indptr=np.array([0, 1, 3, 3]))
    obs = Group(_index=np.array([b"c0", b"c1", b"c2"]), sample=Group(codes=np.array([0, 1, -1]), categories=np.array([b"s0", b"s1"])), n=np.array([4, 5, 6]))
    for k, x in enumerate((dense, sparse)):
        got = anndata.write_study(spark, Group(X=x, obs=obs, var=Group(_index=np.array([b"g0", b"g1", b"g2"]))), f"file://{tmp_path}/study{k}")
        assert sorted(map(tuple, got.expr.collect())) == [(0, 1, 2.0), (1, 0, 1.0), (1, 2, 3.0)]
        assert sorted(map(tuple, got.cells.select("cell_id", "name", "sample", "n").collect())) == [(0, "c0", "s0", "4"), (1, "c1", "s1", "5"), (2, "c2", None, "6")]
        assert [r.name for r in got.genes.orderBy("gene").collect()] == ["g0", "g1", "g2"]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        anndata.read_study(spark, f"file://{tmp_path}/nowhere")
    with pytest.raises(ImportError, match="h5py"):
        anndata.convert_h5ad(spark, "x.h5ad", f"file://{tmp_path}/out")
