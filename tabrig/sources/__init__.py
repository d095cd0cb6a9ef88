"""Sources and sinks: the given tables and derived views, CSV input, model
files and the experiment history tables."""
