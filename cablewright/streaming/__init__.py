"""Replay of event logs, as a batch and as a stream."""
