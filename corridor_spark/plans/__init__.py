"""The analyses, composed from functions, operators and sources."""
