"""Event log sources, the event store and sinks."""
