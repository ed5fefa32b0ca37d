"""Ledger and event-log analytics as plain DataFrame functions."""
