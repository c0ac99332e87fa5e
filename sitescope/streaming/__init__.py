"""Stateful operators on event streams, and the same on landed events."""
