"""DataFrame operators: layers, metrics, keyed tables and event-data processing."""
