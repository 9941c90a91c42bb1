"""Readers and writers of model files, inventories, parameters and tables."""
