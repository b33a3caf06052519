"""Readers: exports, traces, sessions, captures, ledgers, environment files."""
