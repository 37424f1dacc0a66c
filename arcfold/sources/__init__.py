"""Readers, writers, generators and graph views of tables."""
