"""Readers and writers of frame streams, motion records and measurements."""
