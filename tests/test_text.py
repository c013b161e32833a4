"""Text sources and sinks, with the edge cases of their formats."""

import pytest

from rankfold import Matrix
from rankfold.sinks import (
    dense_lines,
    lil_lines,
    metrics_table,
    read_metrics,
    run_averages,
    run_report,
    write_components,
    write_matrix,
    write_metrics,
    write_projection,
    write_report,
)
from rankfold.sources import from_columns, from_triples, from_vectors, read_components, read_coo, read_dense, read_matrix
from rankfold.sources.text import numbered_lines


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def cells(matrix):
    df = matrix.entries if isinstance(matrix, Matrix) else matrix
    return sorted(tuple(r) for r in df.select("row_id", "col_id", "value").collect())


def test_coo_last_duplicate_wins_and_rows_merge(spark, tmp_path):
    path = write(tmp_path / "a.csv", "0,1,1.5\n0,1,2.5\n1,0,3\n0,2,4\n0,1,9\n")
    assert cells(read_coo(spark, path, base=0)) == [(0, 1, 9.0), (0, 2, 4.0), (1, 0, 3.0)]
    assert cells(read_coo(spark, path, base=0, dup="sum"))[0] == (0, 1, 13.0)
    with pytest.raises(Exception, match="duplicate cell"):
        cells(read_coo(spark, path, base=0, dup="error"))


def test_coo_order_over_files(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2), ("c", 3)):
        write(tmp_path / "in" / f"{name}.csv", f"5,5,{value}\n")
    assert cells(read_coo(spark, str(tmp_path / "in"), base=0)) == [(5, 5, 3.0)]


def test_coo_base_cap_and_range(spark, tmp_path):
    path = write(tmp_path / "a.csv", "1,1,1\n1,2,0\n1,4,4\n1,5,5\n2,50001,6\n2,50000,7\n")
    # One-based: the row id stays, the cap applies to the id in the file, n_cols to the shifted one.
    assert cells(read_coo(spark, path, base=1, max_col=50000)) == [(1, 0, 1.0), (1, 3, 4.0), (1, 4, 5.0), (2, 49999, 7.0)]
    assert cells(read_coo(spark, path, base=1, n_cols=4, drop_outside=True)) == [(1, 0, 1.0), (1, 3, 4.0)]
    with pytest.raises(ValueError):
        read_coo(spark, path, base=2)


def test_coo_bad_input(spark, tmp_path):
    negative = write(tmp_path / "neg.csv", "1,0,1\n")
    with pytest.raises(Exception, match="negative column"):
        cells(read_coo(spark, negative, base=1))
    assert cells(read_coo(spark, negative, base=1, mode="DROPMALFORMED")) == []
    bad = write(tmp_path / "bad.csv", "1,2,x\n3,4,5\n")
    with pytest.raises(Exception):
        cells(read_coo(spark, bad, base=0))
    assert cells(read_coo(spark, bad, base=0, mode="DROPMALFORMED")) == [(3, 4, 5.0)]


def test_dense_text(spark, tmp_path):
    write(tmp_path / "in" / "a.txt", "1.0 0 2.5\n\n  3\t4  5 \n   \n")
    write(tmp_path / "in" / "b.txt", "7 8\n")
    rows = {r["row_id"]: r["features"] for r in read_dense(spark, str(tmp_path / "in")).collect()}
    assert rows == {0: [1.0, 0.0, 2.5], 1: [3.0, 4.0, 5.0], 2: [7.0, 8.0]}
    assert cells(from_vectors(read_dense(spark, str(tmp_path / "in" / "a.txt")), "row_id", "features"))[0] == (0, 0, 1.0)
    bad = write(tmp_path / "bad.txt", "1 two\n")
    with pytest.raises(Exception, match="not a number"):
        read_dense(spark, bad).collect()


def test_line_numbers_over_many_splits(spark, tmp_path):
    for f in range(3):
        write(tmp_path / "in" / f"part-{f}.txt", "".join(f"{f * 4000 + i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = numbered_lines(spark, str(tmp_path / "in"))
        assert rows.count() == 12000
        assert rows.filter("line_no <> cast(value AS bigint)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text", ["[0.5]\n[-1.25]\n", "[0.5,2]\n\n[-1.25, 3e-2]\n"])
def test_component_text(spark, tmp_path, text):
    got = sorted(tuple(r) for r in read_components(spark, write(tmp_path / "v.txt", text)).collect())
    assert got[0] == (0, 0, 0.5) and got[-1] in ((1, 0, -1.25), (1, 1, 0.03))


def test_component_roundtrip(spark, tmp_path):
    v = spark.createDataFrame([(i, j, i - j / 7) for i in range(30) for j in range(12)], "col_id bigint, comp int, loading double")
    write_components(v, str(tmp_path / "v"))
    assert sorted(map(tuple, read_components(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, v.collect()))


def test_row_formats(spark, coo, tmp_path):
    m = coo([[1, 0, 2.5, 0], [0, 0, 0, 0], [0, -3, 0, 0.001]])
    rows = spark.range(3).withColumnRenamed("id", "row_id")
    dense = {r["row_id"]: r["value"] for r in dense_lines(m.entries, 4, rows).collect()}
    assert dense == {0: "1.0 0.0 2.5 0.0 ", 1: "0.0 0.0 0.0 0.0 ", 2: "0.0 -3.0 0.0 0.001 "}
    lil = {r["row_id"]: r["value"] for r in lil_lines(m.entries, rows).collect()}
    assert lil == {0: "{0:1.0,2:2.5}", 1: "{}", 2: "{1:-3.0,3:0.001}"}
    assert {r["row_id"] for r in lil_lines(m.entries).collect()} == {0, 2}


def test_written_in_row_order(spark, tmp_path):
    rows = [(i, j, float(i * 10 + j + 1)) for i in range(200) for j in range(3)]
    df = spark.createDataFrame(rows, "row_id bigint, col_id bigint, value double").repartition(8)
    write_matrix(df, str(tmp_path / "dense"), "DENSE", n_cols=3)
    back = from_vectors(read_dense(spark, str(tmp_path / "dense")), "row_id", "features")
    assert cells(back) == rows
    write_matrix(df, str(tmp_path / "coo"), "coo")
    assert cells(read_coo(spark, str(tmp_path / "coo"), base=0)) == rows
    write_matrix(df, str(tmp_path / "lil"), "LIL")
    text = "".join(p.read_text() for p in sorted((tmp_path / "lil").glob("part-*")))
    assert text.splitlines()[0] == "{0:1.0,1:2.0,2:3.0}" and len(text.splitlines()) == 200
    with pytest.raises(ValueError):
        write_matrix(df, str(tmp_path / "x"), "XML")


def test_parquet_matrix(spark, tmp_path):
    df = spark.createDataFrame([(0, [0.0, 2.0, 3.0]), (1, [1.0, 0.0, 0.0])], "row_id bigint, features array<double>")
    df.write.parquet(str(tmp_path / "v"))
    assert cells(read_matrix(spark, str(tmp_path / "v"), n_cols=2, drop_outside=True)) == [(0, 1, 2.0), (1, 0, 1.0)]
    triples = spark.createDataFrame([(0, 1, 2.0), (0, 9, 1.0), (1, 0, 0.0), (1, 1, None)], "row_id bigint, col_id bigint, value double")
    triples.write.parquet(str(tmp_path / "t"))
    m = read_matrix(spark, str(tmp_path / "t"), n_cols=5, partitions=3, drop_outside=True)
    assert cells(m) == [(0, 1, 2.0)]


def test_tables(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 2.0), ("b", 3, 4.0, 0.0)], "k string, n int, x double, y double")
    assert cells(from_columns(df, "k", ["n", "x", "y"])) == [("a", 0, 1.0), ("a", 2, 2.0), ("b", 0, 3.0), ("b", 1, 4.0)]
    assert cells(from_triples(df, "k", "n", "y", dup="sum").measured().entries)[0] == ("a", 1, 2.0)
    m = from_triples(df, "k", "n", "y").measured()
    assert (m.n_rows, m.n_cols) == (2, 4)


def test_projection_formats(spark, tmp_path):
    scores = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.0), (1, 1, 3.0)], "row_id bigint, comp int, score double")
    write_projection(scores, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    write_projection(scores, str(tmp_path / "d"), "DENSE", k=2)
    rows = sorted(r["features"] for r in read_dense(spark, str(tmp_path / "d")).collect())
    assert rows == [[0.0, 3.0], [1.5, 2.0]]
    with_zero = scores.unionByName(spark.createDataFrame([(2, 0, 0.0), (2, 1, 0.0)], scores.schema))
    write_projection(with_zero, str(tmp_path / "z"), "DENSE", k=2)
    assert [r.value for r in spark.read.text(str(tmp_path / "z")).collect()].count("0.0 0.0 ") == 1
    write_projection(with_zero, str(tmp_path / "l"), "LIL", k=2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["{0:1.5,1:2.0}", "{1:3.0}", "{}"]


def test_dense_lines_need_all_columns(spark, coo):
    with pytest.raises(Exception, match="outside the columns"):
        dense_lines(coo([[1.0, 0.0, 0.0, 4.0]]).entries, 2).collect()


def test_sparse_vectors_are_not_filled(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(0, Vectors.sparse(2_000_000_000, {5: 1.5, 1_999_999_999: 2.0})), (1, Vectors.dense([0.0, 3.0])), (2, Vectors.sparse(4, {}))]
    m = from_vectors(spark.createDataFrame(rows, ["k", "v"]), "k", "v")
    assert cells(m.entries) == [(0, 5, 1.5), (0, 1_999_999_999, 2.0), (1, 1, 3.0)]


def test_metrics(spark, tmp_path):
    first = metrics_table(spark, [("pca", "d", 10, 4, 0, 0.5, 1.0, 0.25, 0.0), ("pca", "d", 10, 4, 1, 0.5, 3.0, 0.125, 0.0)])
    second = metrics_table(spark, [("sigma", "d", 10, 4, 0, 0.5, None, None, 7.5)])
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        write_metrics(first, path, fmt)
        write_metrics(second, path, fmt)
        rows = {r["app"]: r for r in run_averages(read_metrics(spark, path, fmt)).collect()}
        assert (rows["pca"]["avg_sketch_sec"], rows["pca"]["total_sketch_sec"], rows["pca"]["n_iter"]) == (2.0, 4.0, 2)
        assert rows["sigma"]["avg_sketch_sec"] is None and rows["sigma"]["n_iter"] == 0
    text = {r["app"]: r["value"].split("\n") for r in run_report(first.unionByName(second)).collect()}
    assert text["pca"] == [
        "App Name: pca",
        "Dataset Name: d",
        "Dimensions: Rows: 10 Cols: 4",
        "Total Runtime: 4.5",
        "Preprocess Time: 0.5",
        "Average PPCA Time: 2.0",
        "Sketch each iteration time: [1.0, 3.0]",
        "Total Iterations: 2",
        "Errors in each iteration: [0.25, 0.125]",
        "******",
    ]
    assert "K Singular Value7.5" in text["sigma"]
    write_report(first, str(tmp_path / "report"))
    write_report(second, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).filter("value = '******'").count() == 2
