"""Runnable jobs. Each has ``run``, which takes a session and paths, a command line, and a config file beside it."""
