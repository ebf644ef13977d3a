"""Sources, sinks and adapters over the driver tables."""
