"""Sources and sinks: files, versioned relations, stashed tables."""
