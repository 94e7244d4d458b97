"""Predicates, aggregates and content ids."""
