"""Readers of source texts: what a file declares, imports, exports, binds and calls."""
