"""Reports as files, by the standard library alone."""
