"""Whole evaluations composed from the operators."""
