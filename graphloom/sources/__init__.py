"""Where tables come from and go to: archives, clones, folders, parsers, Parquet tables."""
