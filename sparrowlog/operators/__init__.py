"""Operators over the canonical frames (encounters, participants, boards, sales, combat, raw payloads)."""
