"""Incremental reading: files that arrive are handled once, and writing a batch again changes nothing."""
