"""Sources and sinks: weekly files, tables, evaluations, telemetry, evaluation cases."""
