"""Readers and writers of cloud, parameter and session files."""
