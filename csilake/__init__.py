"""csilake: Wi-Fi channel-state telemetry on Spark (batch, streaming, tables)."""
