import numpy as np
import pytest

from siftstone.operators import profiling, sketches


def numbers(spark, n, seed, nulls=True):
    random = np.random.default_rng(seed)
    rows = [(i if not nulls or i % 11 else None, float(v), f"t{i % 300}") for i, v in enumerate(random.lognormal(0, 1, n))]
    return spark.createDataFrame(rows, "id long, v double, t string")


def test_merged_rows_equal_one_row_of_everything(spark, tmp_path):
    parts = [numbers(spark, n, n) for n in (5000, 300, 1, 2000)]
    folder = str(tmp_path / "s")
    for i, part in enumerate(parts):
        sketches.append_sketches(sketches.sketch_columns(part, "d", "p", f"r{i}", 202401 + i % 2), folder)
    merged = sketches.merge_sketches(sketches.merge_sketches(sketches.read_sketches(spark, folder)), ["column_name"])
    got = {r.column_name: r for r in sketches.sketched_statistics(merged).collect()}
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).toPandas()
    v = whole.v.to_numpy()
    assert got["v"].non_null_count == len(v) and got["id"].null_count == whole.id.isna().sum()
    assert got["v"].mean == pytest.approx(v.mean()) and got["v"].stddev_pop == pytest.approx(v.std()) and got["v"].min_val == v.min()
    for share, estimate in zip((0.05, 0.25, 0.5, 0.75, 0.95), got["v"].q):
        assert abs((v <= estimate).mean() - share) < 0.01
    for name in ("id", "v", "t"):
        assert got[name].unique_estimate == pytest.approx(whole[name].nunique(), rel=0.01)
    assert got["t"].q is None and got["t"].mean is None


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, None, None)] * 3, "a long, b string, c timestamp")
    rows = sketches.sketch_columns(df)
    for found in (rows, sketches.merge_sketches(rows.unionAll(rows), ["column_name"])):
        for r in sketches.sketched_statistics(found).collect():
            assert r.non_null_count == 0 and r.unique_estimate == 0 and r.null_rate == 1.0 and r.q is None
    empty = sketches.sketched_statistics(sketches.sketch_columns(df.limit(0))).collect()
    assert len(empty) == 3 and all(r.total_rows == 0 and r.null_rate == 0.0 for r in empty)


def test_profile_by_sketches(spark):
    df = numbers(spark, 3000, 5)
    exact = {r.column_name: r for r in profiling.profile_table(df).columns.collect()}
    near = profiling.profile_table(df, approx=True)
    assert near.columns.columns == profiling.profile_table(df).columns.columns
    for r in near.columns.collect():
        e = exact[r.column_name]
        assert (r.null_count, r.min_length, r.mean, r.data_type) == (e.null_count, e.min_length, e.mean, e.data_type)
        assert r.unique_count == pytest.approx(e.unique_count, rel=0.01)
    assert near.table.first().duplicate_count == 0
