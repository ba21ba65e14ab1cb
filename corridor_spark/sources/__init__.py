"""Readers and writers: each returns or takes a DataFrame with a fixed schema."""
