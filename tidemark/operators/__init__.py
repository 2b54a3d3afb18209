"""DataFrame to DataFrame operators over telemetry series."""
