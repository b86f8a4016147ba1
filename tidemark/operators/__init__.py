"""DataFrame operators: timeline, signals, cases, risk, briefings, read models."""
