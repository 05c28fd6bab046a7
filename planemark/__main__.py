"""Command line: compare methods, validate them by logged contacts, tune the gradient. Each writes CSV folders.

    python -m planemark compare --samples S --collars C --surveys V --out DIR [--prospect P | --all-prospects] [--radius R] [--min-neighbors N]
    python -m planemark contacts --samples S --collars C --surveys V --logged L --out DIR
    python -m planemark tune --samples S --collars C --surveys V --logged L --out DIR
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import settings
from .operators import contacts, estimators
from .plans import compare, sweep
from .plans.prepare import prepare_tables
from .sources import tables
from .sources.store import Scratch, written

#: Samples that a prospect needs for a comparison of its own.
PROSPECT_SAMPLES = 1500


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="planemark", description="Local structural orientation from drillhole assays")
    kinds = p.add_subparsers(dest="action", required=True)
    for name in ("compare", "contacts", "tune"):
        k = kinds.add_parser(name)
        for table in ("samples", "collars", "surveys", "out", *(() if name == "compare" else ("logged",))):
            k.add_argument(f"--{table}", required=True)
        k.add_argument("--score", nargs="+", help="assay columns; else the defaults")
        k.add_argument("--quantile", type=float, default=0.85)
        k.add_argument("--radius", type=float, default=120.0)
        k.add_argument("--min-neighbors", type=int, default=100)
        k.add_argument("--min-holes", type=int, default=3)
        if name == "compare":
            which = k.add_mutually_exclusive_group()
            which.add_argument("--prospect")
            which.add_argument("--all-prospects", action="store_true")
    return p.parse_args(given)


def _config(a: argparse.Namespace, **more: Any) -> dict[str, Any]:
    given = {"radius_m": a.radius, "min_neighbors": a.min_neighbors, "min_holes": a.min_holes, "active_score_quantile": a.quantile}
    return settings(**given, **({"score_columns": a.score} if a.score else {}), **more)


def _compare(spark: SparkSession, a: argparse.Namespace, loaded: tuple[DataFrame, DataFrame, DataFrame]) -> list[str]:
    """Scores and ranks are those of each subset, as filters come first."""
    subsets: list[tuple[str, str | None]] = [(a.prospect, a.prospect)] if a.prospect else [("all", None)]
    if a.all_prospects:
        subsets += [(r["Prospect"], r["Prospect"]) for r in tables.prospects_with(loaded[0], loaded[1], PROSPECT_SAMPLES).collect()]
    said, rows = [], None
    for label, prospect in subsets:
        cfg = _config(a, prospect_filter=prospect)
        chosen = tables.chosen_holes(*loaded, cfg)
        if chosen[0].isEmpty():
            said.append(f"{label}: skipped, no samples")
            continue
        out = compare.compared(prepare_tables(*chosen, cfg).active, cfg)
        if out.summary is None:
            said.append(f"{label}: skipped, {out.skipped}")
            continue
        for method, field in out.fields.items():
            tables.write_csv(field, f"{a.out}/orientations_{label.lower().replace(' ', '_')}_{method}.csv")
        row = written(out.summary.withColumn("subset", F.lit(label)), "summary")
        said += [f"{label}: {r['method']} {r['n_valid']} planes, {r['vs_reference_deg']} degrees from the drill pattern" for r in row.collect()]
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    if rows is not None:
        tables.write_csv(rows, f"{a.out}/method_comparison_summary.csv")
    return said


def _surfaces(spark: SparkSession, a: argparse.Namespace, loaded: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    points = written(contacts.extract_contacts(tables.read_table(spark, a.logged), loaded[1], loaded[2]), "contacts")
    return points, written(contacts.fit_contact_planes(points), "planes")


def _contacts(spark: SparkSession, a: argparse.Namespace, loaded: tuple[DataFrame, DataFrame, DataFrame]) -> list[str]:
    points, planes = _surfaces(spark, a, loaded)
    tables.write_csv(points, f"{a.out}/contacts.csv")
    tables.write_csv(planes, f"{a.out}/contact_planes.csv")
    said = [f"{r['code']}/{r['boundary']}: {r['n_holes']} holes, strike {r['strike_deg']:.1f}, dip {r['dip_deg']:.1f}" for r in contacts.head(planes).collect()]
    said += [f"{r['code']}/{r['boundary']}: rejected, from a single fence" for r in contacts.rejected(planes).collect()]
    cfg = _config(a)
    active = prepare_tables(*loaded, cfg).active
    fields = {name: written(estimators.orientations(active, cfg, name), "field") for name in (*compare.METHODS, compare.REFERENCE)}
    rows = written(contacts.compare_fields(fields, planes, points), "comparison")
    tables.write_csv(rows, f"{a.out}/contact_validation.csv")
    return said + [f"{r['method']}: {r['weighted_err_deg']:.1f} degrees, by samples" for r in contacts.weighted_error(rows, ["method"]).collect()]


def _tune(spark: SparkSession, a: argparse.Namespace, loaded: tuple[DataFrame, DataFrame, DataFrame]) -> list[str]:
    points, planes = _surfaces(spark, a, loaded)
    cfg = _config(a)
    out = sweep.sweep(prepare_tables(*loaded, cfg).active, cfg, planes, points)
    tables.write_csv(out, f"{a.out}/lsq_tuning.csv")
    return [str(r.asDict()) for r in out.collect()]


def main(given: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = arguments(given)
    spark = spark or SparkSession.builder.appName("planemark").getOrCreate()
    cfg = _config(a)
    with Scratch():
        loaded = tuple(written(t, "loaded") for t in tables.load_tables(spark, a.samples, a.collars, a.surveys, cfg))
        return {"compare": _compare, "contacts": _contacts, "tune": _tune}[a.action](spark, a, loaded)  # type: ignore[arg-type]


if __name__ == "__main__":
    print("\n".join(main()))
