"""Spark jobs that turn raw text tables into a clean entity-relation graph."""
