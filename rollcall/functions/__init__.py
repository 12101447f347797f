"""Column expressions over text and personal names."""
