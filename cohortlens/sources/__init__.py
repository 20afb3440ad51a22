"""Sources and sinks: table scans, CSV/JDBC, staged writes, views, the encounter adapter."""
