"""Batch jobs that turn meeting transcripts and rosters into attendance tables."""
