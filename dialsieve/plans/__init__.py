"""User-level runs (P1-P5) and the driver query catalog."""
