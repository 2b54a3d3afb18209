"""Roles that columns of an input play, found by name regardless of case."""

from __future__ import annotations

# Column names that the input files use, in order of priority.
TIMESTAMP_NAMES = ("timestamp", "ts", "datetime", "fechahora")
SAMPLE_ASSET_NAMES = ("asset_label", "asset", "assetName", "estanque", "bomba")
ASSET_LABEL = "asset_label"
LEVELS = ("nivelPorcentual", "nivelEstanque")
#: Series keys exported for each group of assets.
GROUP_KEYS = {"estanques": ("nivelPorcentual", "nivelEstanque"), "bombas": ("timeOn", "estadoOn")}
# Cells that mean "no value" in a CSV file.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is there."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def level_columns(columns: list[str]) -> dict[str, str]:
    """Level to the column that holds it; levels without one are left out."""
    return {level: c for level in LEVELS if (c := find_column(columns, (level,)))}
