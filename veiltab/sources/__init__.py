"""Reading and writing tables and their metadata."""
