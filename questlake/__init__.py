"""questlake: player-behaviour analytics and event-data processing on Spark."""

__version__ = "0.1.0"
