"""Tables in storage."""

from .catalog import Catalog, ObservationSet

__all__ = ["Catalog", "ObservationSet"]
