"""Reading and writing of event lines, record caches, shards, file lists and reference tables."""
