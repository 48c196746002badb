"""Shared physical patterns: bounded blocks, scans, nearest and window joins, folds."""
