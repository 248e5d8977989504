"""Capacity analytics for stream-processing jobs, written as Spark DataFrame plans."""

from tidegauge.schemas import Params

__all__ = ["Params"]
