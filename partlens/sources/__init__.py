"""Readers of files and folders: text with provenance, hashes, headers, ledgers of what was read before."""
