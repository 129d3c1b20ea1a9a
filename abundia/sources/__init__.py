"""Readers, writers, declared schemas and scratch tables."""
