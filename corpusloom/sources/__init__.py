"""Sources: table readers, file scans and parsers."""
