"""Readers that turn landed files of one source format into listing rows."""
