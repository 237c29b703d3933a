"""Sections of gantries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def map_gantries(gantry: DataFrame, section: DataFrame) -> DataFrame:
    """Gantry -> section -> name from the tables themselves; an unknown section has no name."""
    return gantry.select("gantry_id", "section_id").join(
        section.select("section_id", "section_name"), "section_id", "left"
    )
