"""Readers: each returns raw records with one schema (RAW), whatever the format."""
