"""Sources: files, record collections, text and configuration."""
