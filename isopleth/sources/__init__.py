"""Reading and writing field tables and station files, and provenance tables."""
