"""Readers and writers: tables, the online store, events, the model registry."""
