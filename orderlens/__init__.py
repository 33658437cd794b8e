"""Ranking-stability analytics."""
