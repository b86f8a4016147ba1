"""Structured Streaming mode: weekly files that arrive one by one."""
