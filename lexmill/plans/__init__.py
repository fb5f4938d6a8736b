"""Stages and queries."""
