"""The whole run, and its command line."""
