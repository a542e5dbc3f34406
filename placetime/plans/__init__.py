"""Query plans over the supplied tables: how they are read as events, series, stops, feeds
and records, and one named query per operator with its SQL counterpart."""
