"""Readers of raw files and data sets, and writers of snapshots."""
