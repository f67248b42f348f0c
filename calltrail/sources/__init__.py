"""Reading, normalising, changing and exporting call tables."""
