"""Staging and mart models of the warehouse under review."""
