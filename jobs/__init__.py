"""Runnable jobs: each a function of a session and plain paths, and a command line."""
