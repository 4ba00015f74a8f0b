"""Landed files to tables, and ranked tables to files."""
