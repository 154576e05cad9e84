"""Readers of change sets: git, folders, tables, unified diffs, pull-request JSON."""
