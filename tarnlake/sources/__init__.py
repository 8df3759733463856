"""Readers, writers and the derived views the queries run on."""
