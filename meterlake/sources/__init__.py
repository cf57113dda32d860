"""Sources and sinks: session logs, price catalogs, reports, and the bridge from the driver's tables."""
