"""Analytics on signals, intervals and transcripts, as DataFrame operations keyed by series."""
