"""Sources and sinks: tables, segments with a manifest, binary logs."""
