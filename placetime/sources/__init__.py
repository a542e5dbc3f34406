"""Readers, event normalisation, the signal registry and sinks."""
