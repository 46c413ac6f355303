"""Whole workflows."""
