"""The tables behind charts, made in Spark; drawing is optional and imports matplotlib late."""

from kairoflow.charts.tables import bar_table, draw, occupancy_table, span_table, timeline_table

__all__ = ["bar_table", "draw", "occupancy_table", "span_table", "timeline_table"]
