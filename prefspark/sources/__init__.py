"""Readers and writers with explicit schemas."""

from prefspark.sources.io import *  # noqa: F401,F403
