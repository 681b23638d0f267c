"""Feed readers, reference tables, append-only log and read-model sinks."""
