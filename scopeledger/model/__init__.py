"""Table schemas and fixed lookup values."""
