"""Sources and sinks: library files, images, archives, attempts, logs, event streams, request files."""
