"""Shared plan shapes: skew-safe ranks, quantiles, bounded broadcasts, views."""
