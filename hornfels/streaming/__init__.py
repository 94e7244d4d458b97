"""Epochs, clients and streams."""
