"""Continuous use of the batch operators over folders that grow."""
