"""Spark-first operators over web archives: urls, pages, frontier, dedupe, rewriting, robots, snapshots, host health."""
