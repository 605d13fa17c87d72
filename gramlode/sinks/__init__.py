"""Writers: parquet, count files, snippet files."""
