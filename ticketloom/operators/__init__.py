"""DataFrame-to-DataFrame operators over the event log and the case table."""
