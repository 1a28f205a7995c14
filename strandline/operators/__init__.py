"""Operators over frame streams, motion records, tiles and measurements."""
