"""Keyed rules over event logs: batch replays and their streaming twins."""
