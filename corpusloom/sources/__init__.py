"""Table readers, corpus views and sinks."""
