"""Panel time-series analytics expressed as Spark DataFrame transformations."""

from tidepanel.spec import PanelSpec

__all__ = ["PanelSpec"]
