"""Packetised sensor telemetry on Spark: capture files and packets to aligned, decoded, windowed sample tables."""
