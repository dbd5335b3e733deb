"""Readers and writers. Trees are laid out as root/generation/game_name/name."""
