"""Readings to hours as they arrive; days and their rules are then the batch operator's."""
