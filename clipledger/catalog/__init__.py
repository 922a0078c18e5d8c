"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from clipledger.catalog import archive, audio, frames, settings, streams, timeline
from clipledger.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "archive", "audio", "frames", "settings", "streams", "timeline"]
