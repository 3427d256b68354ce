"""Readers (SRC-*) and writers (SNK-*)."""
