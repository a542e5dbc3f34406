"""The analytics: spatial assignment, rollups, series metrics, hotspots, settling,
before/after evaluation, place search, concentration, records and quality checks."""
