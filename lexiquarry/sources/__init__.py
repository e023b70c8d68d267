"""Dictionary files as DataFrames."""

from lexiquarry.sources.readers import discover, dictionaries, records

__all__ = ["dictionaries", "discover", "records"]
