"""Operators of a training-data pipeline; nothing else in racelab imports this subpackage."""
