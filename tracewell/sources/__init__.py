"""Readers and writers that turn files and JSON documents into fact tables."""
