"""Operators on timelines: order, sample and hold, offsets, sliding windows, recursion."""
