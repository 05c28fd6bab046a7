"""Finding the standard columns in tables whose headers follow any of several habits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Standard names, and the other names under which exports carry them, in order of preference.
STANDARD = {
    "hole": "HoleID",
    "from": "From_m",
    "to": "To_m",
    "depth": "Depth_m",
    "dip": "Dip",
    "azimuth": "Azimuth",
    "easting": "Easting",
    "northing": "Northing",
    "elevation": "Elevation",
    "length": "Length_m",
    "property": "Property",
    "prospect": "Prospect",
    "holetype": "HoleType",
}
OTHER_NAMES = {
    "hole": ["HOLEID", "HOLE-ID", "HOLE_ID", "BHID", "DHID", "DDHID"],
    "from": ["FROM", "FROM_M", "FROMM", "DEPTH_FROM", "START", "INTERVAL_FROM"],
    "to": ["TO", "TO_M", "TOM", "DEPTH_TO", "END", "INTERVAL_TO"],
    "depth": ["DEPTH", "DEPTH_M", "MD", "MEASUREDDEPTH", "MEASURED_DEPTH"],
    "dip": ["DIP", "DIP_DEG", "DIP_DEGREES"],
    "azimuth": ["AZIMUTH", "AZM", "AZI", "AZIMUTH_DEG", "AZIMUT"],
    "easting": ["EAST", "EASTING", "X", "LOCATIONX", "UTM_E", "E"],
    "northing": ["NORTH", "NORTHING", "Y", "LOCATIONY", "UTM_N", "N"],
    "elevation": ["ELEV", "ELEVATION", "RL", "Z", "LOCATIONZ"],
    "length": ["LENGTH", "LENGTH_M", "TD", "TOTALDEPTH", "DEPTH_TOTAL"],
    "property": ["PROPERTY", "PROP"],
    "prospect": ["PROSPECT", "AREA"],
    "holetype": ["HOLETYPE", "HOLE_TYPE", "TYPE"],
}
REQUIRED = {
    "samples": {"hole", "from", "to"},
    "points": {"hole", "from", "to", "easting", "northing", "elevation"},
    "collars": {"hole", "easting", "northing", "elevation", "length"},
    "surveys": {"hole", "depth", "dip", "azimuth"},
}
BOM = "﻿"


def clean(header: str) -> str:
    """A header without byte order marks, quotes and white space around it."""
    return str(header).strip(" \t\r\n\"'" + BOM).strip()


def find(columns: Sequence[str], key: str, given: str | Sequence[str] | None = None, automatic: bool = True) -> str | None:
    """The column that plays `key`: a given name that is there, else the standard or another name, as written or in any case."""
    for name in [given] if isinstance(given, str) else given or ():
        if name in columns:
            return name
    if not automatic:
        return None
    habits = [STANDARD[key], *OTHER_NAMES[key]]
    exact = next((h for h in habits if h in columns), None)
    if exact is not None:
        return exact
    by_lower = {c.lower(): c for c in columns}  # of columns that differ in case only, the last counts
    return next((by_lower[h.lower()] for h in habits if h.lower() in by_lower), None)


def renamed(df: DataFrame, table: str, names: dict | None = None, automatic: bool = True) -> DataFrame:
    """df with clean headers and its key columns under their standard names; others stay. A missing key column is a KeyError."""
    columns = [clean(c) for c in df.columns]
    new = dict.fromkeys(range(len(columns)), None)
    for key, standard in STANDARD.items():
        source = find(columns, key, (names or {}).get(key), automatic)
        if source is None:
            if key in REQUIRED[table]:
                raise KeyError(f"no column for {standard!r} among {columns[:30]}; name it in columns[{table!r}]")
        elif source != standard:
            new[columns.index(source)] = standard
    out = [new[i] or c for i, c in enumerate(columns)]
    twice = sorted({c for c in out if out.count(c) > 1})
    if twice:
        raise ValueError(f"more than one column would be called {twice}")
    return df.toDF(*out)


def mapping(spark: SparkSession, columns: Sequence[str], table: str, names: dict | None = None, automatic: bool = True) -> DataFrame:
    """What `renamed` would do, one row for each standard column: internal, source, required, status."""
    cleaned = [clean(c) for c in columns]
    rows = []
    for key, standard in STANDARD.items():
        source = find(cleaned, key, (names or {}).get(key), automatic)
        needed = key in REQUIRED[table]
        rows.append((standard, source, needed, "ok" if source else "MISSING" if needed else "-"))
    return spark.createDataFrame(rows, "internal string, source string, required boolean, status string")
