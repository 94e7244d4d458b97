"""Inputs: tables bound to declared relations, facts with content ids, block stores, scratch tables."""
