"""Helpers that decide how a plan is laid out: tables, written intermediates, sizes."""
