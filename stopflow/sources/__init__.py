"""Sources and sinks. Every source has an explicit schema; nothing is inferred from data."""
