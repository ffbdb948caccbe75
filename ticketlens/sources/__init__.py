"""Readers and writers for tickets, splits, reports and small stores."""
