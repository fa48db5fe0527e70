"""Reading, writing and querying the records tables."""
