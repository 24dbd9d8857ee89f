"""Cross-sectional panel analytics as Spark DataFrame operators.

A panel has one row per instrument and calendar date. Every operator takes
DataFrames and returns DataFrames; nothing panel-sized reaches the driver.
"""

from panelwright.config import PanelConfig

__all__ = ["PanelConfig"]
