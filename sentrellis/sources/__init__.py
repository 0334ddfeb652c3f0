"""Readers and writers. Every reader returns a DataFrame, every writer takes one."""
