"""Playback as a stream: the one recurrence of the library kept in state."""
