"""Runnable jobs; each is a function of a session, with a command line and a small config file beside it."""
