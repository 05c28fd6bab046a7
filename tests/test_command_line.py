"""The command line over CSV files, and that nothing of its work stays behind."""

import pytest

from planemark.__main__ import main
from planemark.plans import fixtures as fx
from planemark.sources import store, tables


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    given = {"samples": fx.points(spark, sf).select("HoleID", "From_m", "To_m", "assay"), "collars": fx.collars(spark, sf), "surveys": fx.surveys(spark, sf), "logged": fx.logged(spark, sf)}
    for name, df in given.items():
        tables.write_csv(df, f"{folder}/{name}.csv")
    return [x for name in ("samples", "collars", "surveys") for x in (f"--{name}", f"{folder}/{name}.csv")] + ["--score", "assay", "--quantile", "0.5", "--min-neighbors", "10"], str(folder)


def test_compare(spark, files, tmp_path):
    options, _ = files
    scratch = store.shared_folder(spark)
    before = _tables(scratch)
    said = main(["compare", *options, "--out", str(tmp_path), "--prospect", "Section 0"], spark)
    assert len(said) == 3 and all("planes" in s for s in said)
    rows = tables.read_table(spark, f"{tmp_path}/method_comparison_summary.csv").collect()
    assert {r.method for r in rows} == {"shape_pca", "lsq_gradient", "drill_pattern"} and {r.subset for r in rows} == {"Section 0"}
    assert all(float(r.secs) > 0 for r in rows) and _tables(scratch) == before
    assert main(["compare", *options, "--out", str(tmp_path), "--prospect", "Nowhere"], spark) == ["Nowhere: skipped, no samples"]
    assert "active samples" in main(["compare", *options, "--out", str(tmp_path), "--min-neighbors", "100000"], spark)[0]


def test_contacts(spark, files, tmp_path):
    options, folder = files
    said = main(["contacts", *options, "--logged", f"{folder}/logged.csv", "--out", str(tmp_path)], spark)
    assert any("strike" in s for s in said) and any(s.startswith("drill_pattern") for s in said)
    assert {r.method for r in tables.read_table(spark, f"{tmp_path}/contact_validation.csv").collect()} == {"shape_pca", "lsq_gradient", "drill_pattern"}
    assert tables.read_table(spark, f"{tmp_path}/contact_planes.csv").count() == 10


def _tables(folder):
    import pathlib

    return sorted(p.name for p in pathlib.Path(folder).glob("*"))


def test_csv_text(spark):
    got = tables.csv_text(spark, '\ufeffa,"b, c",d\r\n1,"x ""y""",\r\n\n2,,z\n').collect()
    assert [tuple(r) for r in got] == [("1", 'x "y"', None), ("2", None, "z")]
    for bad in ("", " \n"):
        with pytest.raises(ValueError):
            tables.csv_text(spark, bad)
