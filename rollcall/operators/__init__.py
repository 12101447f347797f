"""DataFrame operators: transcripts, rosters, matching and reports."""
