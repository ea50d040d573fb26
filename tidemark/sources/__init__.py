"""Readers and writers: sensor and fare text files, adapters of tables to event streams, recordings."""
