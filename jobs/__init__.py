"""Runnable jobs over plain paths; each module has a ``run`` that takes a session, and a command line."""
